"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(edges: DataFrame, within: str | None = None) -> DataFrame:
    """(id, label) of every id in edges (a, b); label is the smallest id of its component.

    Each round every vertex points to its smallest neighbour, or itself; pointers are followed twice, and edges are rewritten to where their
    ends point. What a vertex without smaller neighbours stays for, at least one other vertex leaves for, so vertices halve at the least once
    pointers are flat; a star is done in one round. Minima are combined before each shuffle.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges", within)
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    while not edges.isEmpty():
        ways = edges.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))).alias("w")).select("w.*")
        near = written(ways.groupBy("at").agg(F.min("to").alias("to")).select("at", F.least("at", "to").alias("root")), "roots", within)
        hop = lambda n: near.select(F.col("at").alias(f"at{n}"), F.col("root").alias(f"root{n}"))  # noqa: B023, E731
        roots = near.join(hop(1), F.col("root") == F.col("at1")).join(hop(2), F.col("root1") == F.col("at2")).select("at", F.col("root2").alias("root"))
        roots = written(roots, "roots", within)
        end = lambda c: roots.select(F.col("at").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        moved = edges.join(end("a"), "a").join(end("b"), "b").where("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges", within)
        labels = labels.join(roots, F.col("label") == F.col("at"), "left").select("id", F.coalesce("root", "label").alias("label"))
    return written(labels, "components", within)
