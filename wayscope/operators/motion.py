"""Motion between each point and the last one before it with a valid timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite

CLASSES = ("missingTimestamp", "unparsableTimestamp", "nonFiniteDistance", "backward", "zeroTimeDelta")


def pairs(classified: DataFrame) -> DataFrame:
    """track_id, from_index, to_index, pair_class (forward or one of CLASSES), dt_sec, dd_meters, time_raw."""
    dt = F.col("dt_ms")
    kind = (
        F.when(F.col("ts_state") == "missing", "missingTimestamp").when(F.col("ts_state") == "unparsable", "unparsableTimestamp").when(~finite(F.col("anchor_m")), "nonFiniteDistance")
        .when(dt > 0, "forward").when(dt == 0, "zeroTimeDelta").otherwise("backward")
    )
    return classified.where("last is not null").select("track_id", F.col("last.gpx_index").alias("from_index"), F.col("gpx_index").alias("to_index"), kind.alias("pair_class"), (dt / F.lit(1000.0)).alias("dt_sec"), F.col("anchor_m").alias("dd_meters"), "time_raw")


def summary(pairs: DataFrame) -> DataFrame:
    """Per track with pairs: counts per class, times, distance and speeds."""
    is_ = lambda k: F.col("pair_class") == k
    forward = is_("forward")
    speed = F.when(forward, F.col("dd_meters") / F.col("dt_sec"))
    g = pairs.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(forward).alias("forward"), *(F.count_if(is_(k)).alias(k) for k in CLASSES),
        F.coalesce(F.sum(F.when(forward, F.col("dt_sec"))), F.lit(0.0)).alias("valid_sec"), F.coalesce(F.sum(F.when(is_("backward"), -F.col("dt_sec"))), F.lit(0.0)).alias("invalid_sec"),
        F.coalesce(F.sum(F.when(forward, F.col("dd_meters"))), F.lit(0.0)).alias("meters"), F.percentile(speed, F.lit(0.5)).alias("median_mps"), F.max(speed).alias("max_mps"),
    )
    every = F.col("valid_sec") + F.col("invalid_sec")
    return g.withColumns({"invalid_share": F.when(every > 0, F.col("invalid_sec") / every).otherwise(0.0), "mean_mps": F.when(F.col("valid_sec") > 0, F.col("meters") / F.col("valid_sec"))})


def section(classified: DataFrame) -> DataFrame:
    """track_id and the motion section of its document; tracks without a pair have zeros and nulls."""
    p = pairs(classified)
    metres = F.when(finite(F.col("dd_meters")), F.col("dd_meters")).alias("ddMeters")
    ends = (F.col("from_index").alias("fromIndex"), F.col("to_index").alias("toIndex"))
    raw, timed = F.struct(*ends, F.col("time_raw").alias("rawTime"), metres), F.struct(*ends, F.col("dt_sec").alias("dtSec"), metres)
    shape = {k: raw if k.endswith("Timestamp") else timed for k in CLASSES}
    key = F.col("to_index").alias("k")
    listed = p.where("pair_class <> 'forward'").groupBy("track_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("pair_class") == k, F.struct(key, e.alias("e"))))).alias(f"{k}_events") for k, e in shape.items()))
    s = classified.select("track_id").distinct().join(summary(p), "track_id", "left").join(listed, "track_id", "left")
    n = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    x = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    types = {k: "array<struct<fromIndex:bigint,toIndex:bigint,rawTime:string,ddMeters:double>>" if k.endswith("Timestamp") else "array<struct<fromIndex:bigint,toIndex:bigint,dtSec:double,ddMeters:double>>" for k in CLASSES}
    events = F.struct(*(F.coalesce(F.transform(f"{k}_events", lambda v: v["e"]), F.array().cast(types[k])).alias(k) for k in CLASSES))
    names = {"missingTimestamp": "missingTimestampPairCount", "unparsableTimestamp": "unparsableTimestampPairCount", "nonFiniteDistance": "nonFiniteDistancePairCount", "backward": "backwardTimePairCount", "zeroTimeDelta": "zeroTimeDeltaPairCount"}
    motion = F.struct(
        F.struct(n("pairs", "consecutivePairCount"), n("forward", "forwardValidPairCount")).alias("evaluatedPairs"),
        F.struct(*(n(k, v) for k, v in names.items()), events.alias("events")).alias("rejections"),
        F.struct(x("valid_sec", "validMotionTimeSeconds"), x("invalid_sec", "invalidTimeSeconds"), x("invalid_share", "invalidTimeShareOfEvaluatedTime")).alias("time"),
        F.struct(x("meters", "totalForwardValidDistanceMeters")).alias("distance"),
        F.struct(F.col("mean_mps").alias("meanSpeedMps"), F.col("median_mps").alias("medianSpeedMps"), F.col("max_mps").alias("maxSpeedMps")).alias("speed"),
    )
    return s.select("track_id", motion.alias("motion"))
