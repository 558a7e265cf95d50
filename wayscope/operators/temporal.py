"""Temporal order: classes, runs, blocks and isolated events of a track's timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..schemas import KINDS


def summary(classified: DataFrame) -> DataFrame:
    """Counts per class, ratios, depth and duration of each track."""
    is_ = lambda k: F.count_if(F.col("temporal_class") == k)
    timed = F.col("ts_ms").isNotNull()
    first, final = F.min_by("ts_ms", F.when(timed, F.col("gpx_index"))), F.max_by("ts_ms", F.when(timed, F.col("gpx_index")))
    own = classified.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("points_evaluated"), is_("missing").alias("missing"), is_("unparsable").alias("unparsable"), is_("duplicate").alias("duplicate"),
        is_("backtracking").alias("backtracking"), is_("forward").alias("forward"), F.count("ts_ms").alias("parseable"), F.max("depth_ms").alias("max_depth_ms"), (final - first).alias("duration_ms"),
    )
    return own.withColumns({f"{k}_ratio": F.col(k) / F.col("points_evaluated") for k in ("missing", "unparsable", "duplicate")})


def runs(classified: DataFrame) -> DataFrame:
    """track_id, kind, start_index, end_index, length, first_ms, max_depth_ms and head (the first member) of each run of each kind."""
    member = classified.where(F.col("temporal_class").isin(*KINDS))
    head = F.struct("gpx_index", F.col("last.gpx_index").alias("prev_index"), "time_raw", "ts_ms", F.col("last.ts_ms").alias("prev_ms"))
    return member.groupBy("track_id", F.col("temporal_class").alias("kind"), "run").agg(
        F.min("gpx_index").alias("start_index"), F.max("gpx_index").alias("end_index"), F.count(F.lit(1)).alias("length"), F.min_by("ts_ms", "gpx_index").alias("first_ms"), F.max("depth_ms").alias("max_depth_ms"), F.min_by(head, "gpx_index").alias("head"),
    ).drop("run")


def blocks(classified: DataFrame) -> DataFrame:
    """Runs of two or more."""
    return runs(classified).where("length > 1").drop("head")


def isolated(classified: DataFrame) -> DataFrame:
    """Events that are a run by themselves."""
    return runs(classified).where("length = 1").select("track_id", "kind", "head.*")


def section(classified: DataFrame, zone: str = "UTC") -> DataFrame:
    """track_id and the temporal section of its document; clock times are shown in zone."""
    r = runs(classified)
    at = lambda ms: clock(ms, zone)
    block = {
        "missing": F.struct(F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"), "length"),
        "duplicate": F.struct(F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"), "length", at(F.col("first_ms")).alias("time")),
        "backtracking": F.struct(F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"), "length", F.col("max_depth_ms").alias("maxDepthFromAnchorMs")),
    }
    block["unparsable"] = block["missing"]
    index, prev = F.col("head.gpx_index").alias("index"), F.col("head.prev_index").alias("prevIndex")
    event = {
        "missing": F.struct(index), "unparsable": F.struct(index, F.col("head.time_raw").alias("rawTime")), "duplicate": F.struct(index, prev, at(F.col("head.ts_ms")).alias("time")),
        "backtracking": F.struct(index, prev, at(F.col("head.prev_ms")).alias("prevTime"), at(F.col("head.ts_ms")).alias("currTime")),
    }
    aggs = []
    for k in KINDS:
        own = F.col("kind") == k
        aggs += [F.array_sort(F.collect_list(F.when(own & (F.col("length") > 1), block[k]))).alias(f"{k}_blocks"), F.array_sort(F.collect_list(F.when(own & (F.col("length") == 1), event[k]))).alias(f"{k}_events")]
        aggs.append(F.coalesce(F.max(F.when(own & (F.col("length") > 1), F.col("length"))), F.lit(0)).alias(f"{k}_longest"))
    listed = r.groupBy("track_id").agg(*aggs)
    s = summary(classified).join(listed, "track_id", "left")

    def group(k: str):
        empty = lambda c: F.coalesce(c, F.array().cast(listed.schema[c].dataType))
        head = [F.col(k).alias("pointCount")] + ([F.col("max_depth_ms").alias("maxDepthFromAnchorMs")] if k == "backtracking" else [F.col(f"{k}_ratio").alias("pointCountOverTotalPointsRatio")])
        events = empty(f"{k}_events")
        return F.struct(*head, F.coalesce(f"{k}_longest", F.lit(0)).alias("maxBlockLength"), empty(f"{k}_blocks").alias("blocks"), F.size(events).cast("bigint").alias("isolatedPointCount"), events.alias("isolatedPointEvents")).alias(k)

    session = F.struct((F.col("duration_ms") / 1000).alias("rawSessionDurationSec"), F.col("parseable").alias("parseableTimestampPointCount")).alias("session")
    order = F.struct(F.col("forward").alias("monotonicForwardCount"), *map(group, KINDS)).alias("temporalOrder")
    return s.select("track_id", F.struct(F.col("points_evaluated").alias("totalPointsEvaluated"), session, order).alias("temporal"))
