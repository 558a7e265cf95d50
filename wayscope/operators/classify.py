"""One ordered pass over each track tells everything that later sections need about a point and the points before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_ms, finite, haversine
from ..schemas import KINDS as ENDLESS  # kinds of points whose runs go on until something ends them


def place() -> Column:
    return F.struct("gpx_index", "lat", "lon")


def known() -> Column:
    return F.when(F.col("ts_ms").isNotNull(), F.struct("ts_ms", "gpx_index", "time_raw", "lat", "lon"))


def timed(points: DataFrame) -> DataFrame:
    """points with ts_ms and ts_state (missing, unparsable, valid)."""
    read = points.withColumn("ts_ms", epoch_ms(F.col("time_raw")))
    return read.withColumn("ts_state", F.when(F.col("time_raw").isNull(), "missing").when(F.col("ts_ms").isNull(), "unparsable").otherwise("valid"))


def kind_of(state: Column, ts: Column, last_ms: Column, anchor_ms: Column) -> Column:
    """The temporal class of a point by its own time, the last valid time before it and the latest one."""
    kind = F.when(state != "valid", state).when(last_ms.isNull(), "first").when(ts == last_ms, "duplicate")
    return kind.when(ts >= anchor_ms, "forward").otherwise("backtracking")


def ends() -> dict[str, Column]:
    """A run of each kind ends only at these points; whatever else lies in between leaves it open."""
    kind = F.col("temporal_class")
    return {"missing": kind != "missing", "unparsable": F.col("ts_ms").isNotNull(), "duplicate": kind.isin("forward", "backtracking"), "backtracking": kind == "forward"}


def derived(told: DataFrame, runs: dict[str, Column]) -> DataFrame:
    """told (with last, prev, anchor_ms and temporal_class) with run and the figures between points."""
    run = F.coalesce(*(F.when(F.col("temporal_class") == k, r) for k, r in runs.items()))
    ts = F.col("ts_ms")
    return told.withColumns({
        "run": run, "depth_ms": F.when(F.col("temporal_class") == "backtracking", F.col("anchor_ms") - ts), "dt_ms": ts - F.col("last.ts_ms"),
        "prev_index": F.col("prev.gpx_index"), "prev_m": haversine(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")),
        "anchor_m": haversine(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon")),
    }).drop("prev")


def classify(points: DataFrame) -> DataFrame:
    """points with

    ts_ms, ts_state (missing, unparsable, valid); temporal_class (those two, first, duplicate, forward, backtracking);
    last: the last point before with a valid time (ts_ms, gpx_index, time_raw, lat, lon); anchor_ms: the latest time before; depth_ms below it;
    prev_index and prev_m: the point before and the distance from it; anchor_m: the distance from last; dt_ms: the time since last; run:
    which run of its class the point belongs to, for classes that form runs: the index of the point that ended the run before, -1 if none did.

    All window functions share one frame order, so a track is shuffled and sorted once. For tracks too long for a task, see segmented.py.
    """
    order = Window.partitionBy("track_id").orderBy("gpx_index")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    looked = timed(points).withColumns({"last": F.last(known(), ignorenulls=True).over(before), "anchor_ms": F.max("ts_ms").over(before), "prev": F.lag(place()).over(order)})
    told = looked.withColumn("temporal_class", kind_of(F.col("ts_state"), F.col("ts_ms"), F.col("last.ts_ms"), F.col("anchor_ms")))
    return derived(told, {k: F.coalesce(F.last(F.when(e, F.col("gpx_index")), ignorenulls=True).over(upto), F.lit(-1)) for k, e in ends().items()})


def usable_distance(metres: Column) -> Column:
    """Finite and not below 0, where the root is NaN; metres are named once, as in finite()."""
    return finite(F.sqrt(metres))
