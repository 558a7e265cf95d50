"""Sampling: time and distance deltas between points, their statistics and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite
from .classify import usable_distance
from .clustering import ALPHA, cluster_values, descriptors, sequential_clusters


def _seconds(ms):
    return ms / F.lit(1000.0)


def time_deltas(classified: DataFrame) -> DataFrame:
    """Positive time since the last valid timestamp: track_id, from_index, to_index, dt_sec, in the order of to_index."""
    return classified.where("dt_ms > 0").select("track_id", F.col("last.gpx_index").alias("from_index"), F.col("gpx_index").alias("to_index"), _seconds(F.col("dt_ms")).alias("dt_sec"))


def non_positive_pairs(classified: DataFrame) -> DataFrame:
    return classified.where("dt_ms <= 0").select("track_id", F.col("last.gpx_index").alias("from_index"), F.col("gpx_index").alias("to_index"), F.col("dt_ms").alias("delta_ms"))


def distance_deltas(classified: DataFrame, *more: str) -> DataFrame:
    """track_id, from_index, to_index, dd_meters, on_progress: adjacent points' usable distances; on_progress where time moved forward too. more: further columns."""
    return classified.where(F.col("prev_index").isNotNull() & usable_distance(F.col("prev_m"))).select("track_id", F.col("prev_index").alias("from_index"), F.col("gpx_index").alias("to_index"), F.col("prev_m").alias("dd_meters"), F.coalesce(F.col("dt_ms") > 0, F.lit(False)).alias("on_progress"), *more)


def _moving() -> Column:
    """Whether any time of the point's track moved forward. Tracks lie together where classify() left them, so points are read once."""
    return F.max(F.coalesce(F.col("dt_ms") > 0, F.lit(False))).over(Window.partitionBy("track_id"))


def primary_distances(classified: DataFrame) -> DataFrame:
    """The distance series that charts use: of pairs with forward time where the track has any, else of all pairs."""
    d = distance_deltas(classified.withColumn("moving", _moving()), "moving")
    return d.where("track_id is not null and (on_progress or not moving)").drop("moving")


def series(classified: DataFrame) -> DataFrame:
    """track_id, kind, value: the values of time_deltas() as kind 0 and of primary_distances() as kind 1, from one reading of the points."""
    known = classified.select("track_id", "dt_ms", F.when(F.col("prev_index").isNotNull(), F.col("prev_m")).alias("metres")).withColumn("moving", _moving())
    forward = F.coalesce(F.col("dt_ms") > 0, F.lit(False))
    time = F.struct(F.lit(0).alias("kind"), F.when(forward, _seconds(F.col("dt_ms"))).alias("value"))
    distance = F.struct(F.lit(1).alias("kind"), F.when(F.col("track_id").isNotNull() & (forward | ~F.col("moving")), F.col("metres")).alias("value"))
    each = known.select("track_id", F.explode(F.array(time, distance)).alias("v")).select("track_id", "v.kind", "v.value")
    return each.where(usable_distance(F.col("value")))  # times are positive


def joint_pairs(classified: DataFrame) -> DataFrame:
    """Adjacent points with valid times, forward time and a positive distance: dt_sec with dd_meters. An extension, as documented for charts."""
    both = (F.col("last.gpx_index") == F.col("prev_index")) & (F.col("dt_ms") > 0) & finite(F.col("prev_m")) & (F.col("prev_m") > 0)
    return classified.where(both).select("track_id", F.col("prev_index").alias("from_index"), F.col("gpx_index").alias("to_index"), _seconds(F.col("dt_ms")).alias("dt_sec"), F.col("prev_m").alias("dd_meters"))


def context(classified: DataFrame) -> DataFrame:
    """Per track: counts of timestamps, pairs and deltas, delta statistics (ms) and pair counts of the distance part."""
    dt = F.col("dt_ms")
    up = F.when(dt > 0, _seconds(dt))
    pair, good = F.col("prev_index").isNotNull(), usable_distance(F.col("prev_m"))
    return classified.groupBy("track_id").agg(
        F.count("ts_ms").alias("timestamped_points"), F.count(dt).alias("timestamp_pairs"), F.count_if(dt > 0).alias("positive_deltas"), F.count_if(dt <= 0).alias("non_positive_pairs"),
        (F.min(up) * 1000).alias("min_ms"), (F.max(up) * 1000).alias("max_ms"), (F.percentile(up, F.lit(0.5)) * 1000).alias("median_ms"),
        F.count_if(pair).alias("consecutive_pairs"), F.count_if(pair & ~good).alias("invalid_distances"), F.count_if(pair & good).alias("geometry_deltas"), F.count_if(pair & good & (dt > 0)).alias("time_conditioned_deltas"),
    )


def section(classified: DataFrame) -> DataFrame:
    """track_id and the sampling section of its document."""
    c = context(classified)
    events = non_positive_pairs(classified).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("to_index", F.struct(F.col("from_index").alias("fromIndex"), F.col("to_index").alias("toIndex"), F.col("delta_ms").alias("delta")).alias("e")))).alias("pairs"))
    deltas = time_deltas(classified)
    values = cluster_values(deltas)
    described = descriptors(values)
    listed = described.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("far"), F.col("centerSec").alias("c"), F.struct(*[x for x in described.columns if x not in ("track_id", "cluster")]).alias("d")))).alias("clusters"))
    norm = normalization(values, sequential_clusters(deltas))
    s = c.join(events, "track_id", "left").join(listed, "track_id", "left").join(norm, "track_id", "left")
    n = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    ratios = ("sortedClusterCountOverTotalDeltasRatio", "sequentialClusterCountOverTotalDeltasRatio", "sequentialOverSortedClusterCountRatio")
    clusters = F.transform("clusters", lambda x: x["d"])
    none = lambda col, like: F.coalesce(col, F.array().cast(like))
    of = lambda frame, c: frame.schema[c].dataType
    time = F.struct(
        F.struct(
            (F.col("timestamped_points") > 0).alias("hasAnyParseableTimestamp"), (F.col("positive_deltas") > 0).alias("hasAnyPositiveTimeDelta"), F.col("timestamped_points").alias("timestampedPointsCount"),
            F.col("timestamp_pairs").alias("consecutiveTimestampPairsCount"), F.col("positive_deltas").alias("positiveTimeDeltaCount"),
            F.struct(F.struct(F.col("non_positive_pairs").alias("nonPositivePairCount"), none(F.transform("pairs", lambda x: x["e"]), "array<struct<fromIndex:bigint,toIndex:bigint,delta:bigint>>").alias("events")).alias("nonPositiveTimeDeltaPairs")).alias("rejections"),
        ).alias("timestampContext"),
        F.struct(F.col("positive_deltas").alias("positiveDeltaCount"), F.col("min_ms").alias("minMs"), F.col("max_ms").alias("maxMs"), F.col("median_ms").alias("medianMs")).alias("deltaStatistics"),
        F.struct(F.lit(ALPHA).alias("insertionRelativeThreshold"), n("sortedClusterCount"), n("sequentialClusterCount"), *map(n, ratios), none(clusters, s.select(clusters.alias("x")).schema["x"].dataType).alias("clusters")).alias("clustering"),
        F.when(F.col("sortedClusterCount").isNotNull(), F.struct(*[F.col(x) for x in norm.columns if x != "track_id"])).alias("normalization"),
    )
    distance = F.struct(
        F.struct(F.col("consecutive_pairs").alias("consecutivePairCount"), F.struct(F.struct(F.col("invalid_distances").alias("count")).alias("invalidDistance")).alias("rejections")).alias("pairInspection"),
        F.struct(F.col("geometry_deltas").alias("deltaCount")).alias("geometryConditioned"), F.struct(F.col("time_conditioned_deltas").alias("deltaCount")).alias("timeConditioned"),
    )
    return s.select("track_id", F.struct(time.alias("time"), distance.alias("distance")).alias("sampling"))


def normalization(values: DataFrame, sequential: DataFrame) -> DataFrame:
    """Per track with deltas: counts of clusters both ways (cluster_values() and sequential_clusters()), and how far deltas lie from final centres."""
    off, n = F.abs(F.col("value") - F.col("center")), F.col("n")
    rel = F.when(F.col("center") > 0, off / F.col("center")).otherwise(0.0)
    g = values.groupBy("track_id").agg(
        F.lit(ALPHA).alias("insertionRelativeThreshold"), (F.max("cluster") + 1).alias("sortedClusterCount"),
        (F.sum(off * n) / F.sum(n)).alias("meanFinalAbsoluteDeviationSec"), F.max(off).alias("maxFinalAbsoluteDeviationSec"),
        (F.sum(rel * n) / F.sum(n)).alias("meanFinalRelativeDeviation"), F.max(rel).alias("maxFinalRelativeDeviation"), F.sum(n).alias("n"),
        F.sum(F.when(off > 0, n).otherwise(0)).alias("nonZeroFinalDeviationCount"), F.sum(F.when(off <= 0, n).otherwise(0)).alias("zeroFinalDeviationCount"),
    )
    own = g.join(sequential.withColumnRenamed("sequential_clusters", "sequentialClusterCount"), "track_id")
    by_sorted = F.when(F.col("sortedClusterCount") <= 1, 1.0).otherwise(F.col("sequentialClusterCount") / F.col("sortedClusterCount"))
    return own.select(
        "track_id", "insertionRelativeThreshold", "sortedClusterCount", "sequentialClusterCount", "meanFinalAbsoluteDeviationSec", "maxFinalAbsoluteDeviationSec", "meanFinalRelativeDeviation", "maxFinalRelativeDeviation",
        (F.col("sortedClusterCount") / F.col("n")).alias("sortedClusterCountOverTotalDeltasRatio"), (F.col("sequentialClusterCount") / F.col("n")).alias("sequentialClusterCountOverTotalDeltasRatio"),
        by_sorted.alias("sequentialOverSortedClusterCountRatio"), "nonZeroFinalDeviationCount", "zeroFinalDeviationCount",
    )
