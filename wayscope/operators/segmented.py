"""classify() for tracks of any length: many tasks share one track.

A track is cut into chunks by gpx_index. Each chunk is looked at alone and summed up in a state of fixed size: its last point, its first and last
valid times, its latest time, and the last point that would end each kind of run. States combine by an associative rule, so those before each
chunk are combined by windows over chunks, of which there is one for each chunk_points points; a second look at the chunk, with what was
carried to it, gives every point the columns of classify().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import ENDLESS, derived, ends, kind_of, known, place, timed

CHUNK_POINTS = 1 << 16


def _first_look(points: DataFrame, chunk_points: int) -> DataFrame:
    """timed() points with chunk and, from their own chunk alone, last (the last valid point before), anchor_ms (the latest time before) and prev."""
    order = Window.partitionBy("track_id", "chunk").orderBy("gpx_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = timed(points).withColumn("chunk", F.floor(F.col("gpx_index") / F.lit(chunk_points)))
    return cut.withColumns({"last": F.last(known(), ignorenulls=True).over(before), "anchor_ms": F.max("ts_ms").over(before), "prev": F.lag(place()).over(order)})


def states(looked: DataFrame) -> DataFrame:
    """Of each chunk: tail, its last point; opening and last, its first and last valid points; top_ms; and the last points that end runs of each kind
    (missing_end, unparsable_end), or would if later times decide: turned, the last one whose time differs from the valid one before it within
    the chunk, and risen, of those the last one not below any time before it there.

    Times of risen points never fall, so if the last one lies below what is carried to the chunk, they all do.
    """
    at = F.col("gpx_index")
    moved = F.col("last").isNotNull() & (F.col("ts_ms") != F.col("last.ts_ms"))
    point = F.struct("gpx_index", "ts_ms")
    latest = lambda x, where: F.max_by(x, F.when(where, at))
    return looked.groupBy("track_id", "chunk").agg(
        F.max_by(place(), at).alias("tail"), F.min_by(point, F.when(F.col("ts_ms").isNotNull(), at)).alias("opening"), latest(known(), F.col("ts_ms").isNotNull()).alias("last"), F.max("ts_ms").alias("top_ms"),
        F.max(F.when(F.col("ts_state") != "missing", at)).alias("missing_end"), F.max(F.when(F.col("ts_ms").isNotNull(), at)).alias("unparsable_end"),
        F.max(F.when(moved, at)).alias("turned"), latest(point, moved & (F.col("ts_ms") >= F.col("anchor_ms"))).alias("risen"),
    )


def carried(chunks: DataFrame) -> DataFrame:
    """Of each chunk, what lies before it in its track: prev, last, anchor_ms, and the last end of each kind of run. A row per chunk is all that is sorted."""
    order = Window.partitionBy("track_id").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = chunks.withColumns({"c_prev": F.lag("tail").over(order), "c_last": F.last("last", ignorenulls=True).over(before), "c_anchor": F.max("top_ms").over(before)})
    # With the times before it known, the chunk's first valid point is told, and whether its risen point still counts.
    opens = kind_of(F.lit("valid"), F.col("opening.ts_ms"), F.col("c_last.ts_ms"), F.col("c_anchor"))
    has = F.col("opening").isNotNull()
    turned = F.coalesce("turned", F.when(has & opens.isin("forward", "backtracking"), F.col("opening.gpx_index")))
    risen = F.when(F.col("risen.ts_ms") >= F.coalesce("c_anchor", "risen.ts_ms"), F.col("risen.gpx_index"))
    risen = F.coalesce(risen, F.when(has & (opens == "forward"), F.col("opening.gpx_index")))
    told = own.withColumns({"duplicate_end": turned, "backtracking_end": risen})
    latest = {f"c_{k}": F.max(f"{k}_end").over(before) for k in ENDLESS}
    return told.withColumns(latest).select("track_id", "chunk", "c_prev", "c_last", "c_anchor", *latest)


def classify_segmented(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """The rows and columns of classify(points), for tracks of any length: a task holds chunks of at most chunk_points indices. Points
    are exchanged by chunk, and a second time with only what the states need. Points of a track must have different indices, as those of every source here do."""
    looked = _first_look(points, chunk_points)
    met = looked.join(carried(states(looked)), ["track_id", "chunk"])
    last = F.when(F.col("last").isNotNull(), F.col("last")).otherwise(F.col("c_last"))
    prev = F.when(F.col("prev").isNotNull(), F.col("prev")).otherwise(F.col("c_prev"))
    told = met.withColumns({"last": last, "prev": prev, "anchor_ms": F.greatest("anchor_ms", "c_anchor")})
    told = told.withColumn("temporal_class", kind_of(F.col("ts_state"), F.col("ts_ms"), F.col("last.ts_ms"), F.col("anchor_ms")))
    upto = Window.partitionBy("track_id", "chunk").orderBy("gpx_index").rowsBetween(Window.unboundedPreceding, 0)

    def run_of(kind: str, end: Column) -> Column:
        return F.coalesce(F.last(F.when(end, F.col("gpx_index")), ignorenulls=True).over(upto), F.col(f"c_{kind}"), F.lit(-1))

    return derived(told, {k: run_of(k, e) for k, e in ends().items()}).drop("chunk", "c_prev", "c_last", "c_anchor", *(f"c_{k}" for k in ENDLESS))
