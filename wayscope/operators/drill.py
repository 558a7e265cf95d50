"""Drill-down into a track: blocks, bounds, nearest points."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_ms, finite, fixed, haversine
from .classify import usable_distance


def local_block(points: DataFrame, first: int, last: int) -> DataFrame:
    """Per track: cumulative_m, displacement_m, points and elapsed_sec of the points with index first to last; tracks without any have zeros.
    elapsed_sec is null below two points, or where the first or last has no valid time."""
    own = points.where(F.col("gpx_index").between(first, last)).withColumn("ms", epoch_ms(F.col("time_raw")))
    w = Window.partitionBy("track_id").orderBy("gpx_index")
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    at = F.struct("lat", "lon", "ms")
    g = own.withColumn("step", step).groupBy("track_id").agg(F.sum(F.when(usable_distance(F.col("step")), F.col("step"))).alias("m"), F.count(F.lit(1)).alias("n"), F.min_by(at, "gpx_index").alias("a"), F.max_by(at, "gpx_index").alias("b"))
    apart = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    out = points.select("track_id").distinct().join(g, "track_id", "left")
    return out.select("track_id", F.coalesce("m", F.lit(0.0)).alias("cumulative_m"), F.when((F.col("n") > 1) & finite(apart), apart).otherwise(0.0).alias("displacement_m"), F.coalesce("n", F.lit(0)).alias("points"), F.when(F.col("n") > 1, (F.col("b.ms") - F.col("a.ms")) / 1000).alias("elapsed_sec"))


def block_edge(text: str | None) -> int:
    """The whole number that a user's text begins with; 0 where it begins with none."""
    m = re.match(r"\s*([+-]?[0-9]+)", text or "")
    return int(m[1]) if m else 0


def block_text(block: DataFrame) -> DataFrame:
    """track_id and text of what local_block() gives: a line per figure, two decimals."""
    two = lambda c: fixed(F.col(c), 2)
    lines = (F.lit("cumulativeDistanceM: "), two("cumulative_m")), (F.lit("netDisplacementM: "), two("displacement_m")), (F.lit("pointCount: "), F.col("points").cast("string"))
    elapsed = F.concat(F.lit("elapsedTimeSec: "), F.when(F.col("elapsed_sec").isNotNull(), two("elapsed_sec")).otherwise("null"))
    return block.select("track_id", F.concat_ws("\n", *(F.concat(*x) for x in lines), elapsed).alias("text"))


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")))


def neighbourhood(points: DataFrame, index: int, reach: int = 100) -> DataFrame:
    """Bounds of the points up to reach places before and after the point with that index, in each track that has it."""
    placed = points.withColumn("pos", F.row_number().over(Window.partitionBy("track_id").orderBy("gpx_index")))
    at = placed.where(F.col("gpx_index") == index).select("track_id", F.col("pos").alias("at"))
    return bounds(placed.join(at, "track_id").where(F.abs(F.col("pos") - F.col("at")) <= reach))


def polyline(points: DataFrame) -> DataFrame:
    """track_id and its route as an ordered array of (gpx_index, lat, lon)."""
    return points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("gpx_index", "lat", "lon"))).alias("route"))
