"""Tables that cut lineage: written once to the folder that all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder kept for the session, on a local master only: executors of a
    cluster would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.wayscope.scratch", "")
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset; name a folder there that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="wayscope-")
        spark.conf.set("spark.wayscope.scratch", at)
    return at.rstrip("/")


_KEEPING: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of all tables and workspaces made within, for whoever knows when they are done with."""
    made: list[str] = []
    _KEEPING.append(made)
    try:
        yield made
    finally:
        _KEEPING.remove(made)


def _noted(path: str) -> str:
    for made in _KEEPING:
        made.append(path)
    return path


def workspace(spark: SparkSession, name: str) -> str:
    """A folder of its own for the tables of one call."""
    return _noted(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, or in a workspace there; a lost executor costs no recomputation of what lies before it."""
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else _noted(f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a workspace; no table in it may be read after this."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def require_whole_ids(docs: DataFrame, id_col: str) -> None:
    """Raise unless ids are whole numbers: other ids can't be compared by size, so rows would have to be numbered first."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType | T.NullType) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
        raise TypeError(f"{id_col} has type {kind.simpleString()}; number the rows by whole numbers first")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
