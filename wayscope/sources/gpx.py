"""GPX documents as rows of found points, in stream order: waypoints, route points, track points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trimmed
from ..schemas import FOUND, POINT_TYPES

_POINT = "ARRAY<STRUCT<_lat: STRING, _lon: STRING, ele: STRING, time: STRING, extensions: STRING>>"
_GPX = f"wpt {_POINT}, rte ARRAY<STRUCT<rtept: {_POINT}>>, trk ARRAY<STRUCT<trkseg: ARRAY<STRUCT<trkpt: {_POINT}>>>>, _corrupt_record STRING"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """track_id (file name without extension), file_name, xml; one row per file. path: a folder, file or glob."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_name"))
    return files.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("track_id"), F.col("path").alias("file_name"), F.col("value").alias("xml"))


def _flat(nested: Column) -> Column:
    """flatten() that skips null elements instead of returning null."""
    return F.coalesce(F.flatten(F.filter(nested, lambda x: x.isNotNull())), F.array())


def _tagged(points: Column, point_type: str) -> Column:
    none = F.array().cast("array<struct<point_type:string,raw_lat:string,raw_lon:string,raw_ele:string,raw_time:string,extensions:string>>")
    row = lambda p: F.struct(F.lit(point_type).alias("point_type"), p["_lat"].alias("raw_lat"), p["_lon"].alias("raw_lon"), p["ele"].alias("raw_ele"), trimmed(p["time"]).alias("raw_time"), p["extensions"].alias("extensions"))
    return F.coalesce(F.transform(points, row), none)


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.select("track_id", "file_name", F.from_xml("xml", _GPX, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("gpx"))


def malformed_files(raw: DataFrame) -> DataFrame:
    """track_id and file_name of the documents that aren't well-formed."""
    return _parsed(raw).where("gpx._corrupt_record is not null").select("track_id", "file_name")


def found_points(raw: DataFrame, descendants: bool = False, skip_malformed: bool = False) -> DataFrame:
    """Every point element of each document with a running gpx_index, which rejected points use up too.

    By default built-in XML parsing reads the GPX structure, and extensions as the XML inside them. A malformed document fails the query, or is
    left out if skip_malformed (malformed_files() tells which). descendants: points, and their first ele, time and extensions (as a whole
    element), are found anywhere in the tree, document by document in Python workers.
    """
    if descendants:
        return raw.select("track_id", "file_name", "xml").mapInPandas(_descend(skip_malformed), FOUND)
    parsed, bad = _parsed(raw), F.col("gpx._corrupt_record").isNotNull()
    if skip_malformed:
        parsed = parsed.where(~bad)
    else:
        broken = F.raise_error(F.concat(F.lit("malformed document: "), "file_name")).cast(parsed.schema["gpx"].dataType)
        parsed = parsed.withColumn("gpx", F.when(bad, broken).otherwise(F.col("gpx")))
    routes = _flat(F.transform("gpx.rte", lambda r: r["rtept"]))
    segments = _flat(F.transform("gpx.trk", lambda t: t["trkseg"]))
    tracks = _flat(F.transform(segments, lambda s: s["trkpt"]))
    every = F.concat(_tagged(F.col("gpx.wpt"), "wpt"), _tagged(routes, "rtept"), _tagged(tracks, "trkpt"))
    rows = parsed.select("track_id", "file_name", F.posexplode(every).alias("gpx_index", "p"))
    return rows.select("track_id", "file_name", F.col("gpx_index").cast("bigint"), "p.*")


def _descend(skip_malformed: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        local = lambda e: re.sub(r"^\{.*\}", "", e.tag) if isinstance(e.tag, str) else ""
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for frame in frames:
            rows = []
            for track, name, xml in zip(frame.track_id, frame.file_name, frame.xml, strict=True):
                try:
                    elements = list(ElementTree.fromstring(xml).iter())
                except ElementTree.ParseError:
                    if skip_malformed:
                        continue
                    raise
                index = 0
                for kind in POINT_TYPES:
                    for e in elements:
                        if local(e) == kind:
                            inner = {}
                            for x in e.iter():
                                if x is not e:
                                    inner.setdefault(local(x), x)
                            text = lambda k, inner=inner: "".join(inner[k].itertext()) if k in inner else None
                            time = text("time")
                            extensions = ElementTree.tostring(inner["extensions"], encoding="unicode") if "extensions" in inner else None
                            rows.append((track, name, index, kind, e.get("lat"), e.get("lon"), text("ele"), time and time.strip(), extensions))
                            index += 1
            yield pd.DataFrame(rows, columns=columns)

    return run
