"""Temporal classes and motion pairs of a stream of points, point by point as they arrive.

Row windows don't run on streams, so each track keeps a small state: the latest time so far and the last point with a valid time. Points
of a track must arrive in the order of gpx_index; within a batch they are sorted. Medians and clusters need all values and stay batch work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import epoch_ms

_OUT = "track_id string, gpx_index bigint, temporal_class string, prev_index bigint, dt_ms bigint, depth_ms bigint"
_STATE = "anchor_ms bigint, last_ms bigint, last_index bigint"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    anchor, last, index = state.get if state.exists else (None, None, None)
    rows = []
    for p in pd.concat(list(frames)).sort_values("gpx_index").itertuples():
        ms = None if pd.isna(p.ts_ms) else int(p.ts_ms)
        before, at, depth = last, index, None
        if ms is None:
            kind = p.ts_state
        elif last is None:
            kind = "first"
        elif ms == last:
            kind = "duplicate"
        elif ms >= anchor:
            kind = "forward"
        else:
            kind, depth = "backtracking", anchor - ms
        rows.append((key[0], p.gpx_index, kind, at, None if ms is None or before is None else ms - before, depth))
        if ms is not None:
            anchor, last, index = max(ms, ms if anchor is None else anchor), ms, p.gpx_index
    state.update((anchor, last, index))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    yield out.astype({c: "Int64" for c in ("gpx_index", "prev_index", "dt_ms", "depth_ms")})


def classify_stream(points: DataFrame) -> DataFrame:
    """points: a streaming frame with track_id, gpx_index, time_raw. The classes are those of the batch operator."""
    ts = F.col("ts_ms")
    timed = points.select("track_id", "gpx_index", "time_raw", epoch_ms(F.col("time_raw")).alias("ts_ms"))
    told = timed.select("track_id", "gpx_index", "ts_ms", F.when(F.col("time_raw").isNull(), "missing").when(ts.isNull(), "unparsable").otherwise("valid").alias("ts_state"))
    return told.groupBy("track_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
