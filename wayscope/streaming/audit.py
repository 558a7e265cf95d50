"""The audit of a stream of points: runs as they end, motion pairs, and each track's counts when it is over.

Row windows don't run on streams, so each track keeps a small state: the last valid point and the latest time, the runs that are open (a map by
kind), counts (a map by class), and, where points may come in a wrong order, the last few points held back (a list). A track is over when
its end is said, or when it was idle for so long; then its open runs are given out and its state goes.

Medians and clusters need all values of a track and stay batch work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import EARTH_RADIUS_M
from ..operators.classify import timed
from ..schemas import KINDS

FINDINGS = (
    "track_id string, finding string, kind string, start_index bigint, end_index bigint, length bigint, first_ms bigint, max_depth_ms bigint, "
    "gpx_index bigint, prev_index bigint, time_raw string, ts_ms bigint, prev_ms bigint, dt_sec double, dd_meters double"
)
_COLUMNS = [c.split()[0] for c in FINDINGS.split(", ")]
_WHOLE = [c.split()[0] for c in FINDINGS.split(", ") if c.endswith("bigint")]
_LAST = "anchor_ms bigint, ts_ms bigint, gpx_index bigint, lat double, lon double"
_RUN = "start_index bigint, end_index bigint, length bigint, first_ms bigint, max_depth_ms bigint, prev_index bigint, time_raw string, ts_ms bigint, prev_ms bigint"
_POINT = "gpx_index bigint, time_raw string, ts_ms bigint, ts_state string, lat double, lon double"
#: What ends an open run of each kind, by the class of a point.
_ENDS = {
    "missing": {"unparsable", "first", "duplicate", "forward", "backtracking"}, "unparsable": {"first", "duplicate", "forward", "backtracking"},
    "duplicate": {"forward", "backtracking"}, "backtracking": {"forward"},
}
_NO_MOTION = {"missing": "missingTimestamp", "unparsable": "unparsableTimestamp"}


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """haversine() of two positions as numbers."""
    half_lat, half_lon = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lon * half_lon
    return EARTH_RADIUS_M * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) if a <= 1 else math.nan


class Track:
    """One track's state as plain values; point() takes it a point further and says what was found."""

    def __init__(self, last: tuple | None, runs: dict[str, tuple], counts: dict[str, int]):
        self.last, self.runs, self.counts = last, runs, counts

    def _ended(self, kind: str) -> dict[str, Any]:
        names = [c.split()[0] for c in _RUN.split(", ")]
        own = dict(zip(names, self.runs.pop(kind), strict=True))
        return own | {"finding": "run", "kind": kind, "gpx_index": own["start_index"]}

    def point(self, index: int, raw: str | None, ms: int | None, state: str, lat: float, lon: float) -> Iterator[dict[str, Any]]:
        anchor, last_ms, last_index, last_lat, last_lon = self.last or (None,) * 5
        depth = None
        if state != "valid":
            kind = state
        elif last_ms is None:
            kind = "first"
        elif ms == last_ms:
            kind = "duplicate"
        elif ms >= anchor:
            kind = "forward"
        else:
            kind, depth = "backtracking", anchor - ms
        self.counts[kind] = self.counts.get(kind, 0) + 1
        for k in [k for k in self.runs if kind in _ENDS[k]]:
            yield self._ended(k)
        if kind in KINDS:
            if kind in self.runs:
                start, _, n, first, deepest, *head = self.runs[kind]
                self.runs[kind] = (start, index, n + 1, first, deepest if depth is None else max(deepest, depth), *head)
            else:
                self.runs[kind] = (index, index, 1, ms, depth, last_index, raw, ms, last_ms)
        if last_index is not None:
            far = metres(last_lat, last_lon, lat, lon)
            passed = None if ms is None else ms - last_ms
            motion = _NO_MOTION.get(kind) or ("nonFiniteDistance" if not math.isfinite(far) else "forward" if passed > 0 else "zeroTimeDelta" if passed == 0 else "backward")
            yield {"finding": "pair", "kind": motion, "gpx_index": index, "prev_index": last_index, "time_raw": raw, "dt_sec": None if passed is None else passed / 1000, "dd_meters": far}
        if ms is not None:
            self.last = (ms if anchor is None else max(anchor, ms), ms, index, lat, lon)

    def over(self) -> Iterator[dict[str, Any]]:
        for kind in list(self.runs):
            yield self._ended(kind)
        for kind, n in self.counts.items():
            yield {"finding": "count", "kind": kind, "length": n}


class _Audit(StatefulProcessor):
    def __init__(self, held: int, idle_ms: int | None):
        self.held, self.idle_ms = held, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)
        self.runs = handle.getMapState("runs", "kind string", _RUN)
        self.counts = handle.getMapState("counts", "kind string", "n bigint")
        self.waiting = handle.getListState("waiting", _POINT)

    def _track(self) -> Track:
        return Track(self.last.get(), {k[0]: tuple(v) for k, v in self.runs.iterator()}, {k[0]: v[0] for k, v in self.counts.iterator()})

    def _keep(self, track: Track, before: Track) -> None:
        """Write what changed."""
        if track.last != before.last:
            self.last.update(track.last)
        for k in before.runs.keys() - track.runs.keys():
            self.runs.removeKey((k,))
        for k, v in track.runs.items():
            if before.runs.get(k) != v:
                self.runs.updateValue((k,), v)
        for k, v in track.counts.items():
            if before.counts.get(k) != v:
                self.counts.updateValue((k,), (v,))

    def _waiting(self) -> list[tuple]:
        return [tuple(x) for x in self.waiting.get()]

    @staticmethod
    def _rows(key: tuple, found: list[dict[str, Any]]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=_COLUMNS, dtype=object).assign(track_id=key[0])
        return out.astype({c: "Int64" for c in _WHOLE} | {"dt_sec": float, "dd_meters": float})

    def _over(self, track: Track, points: list[tuple]) -> list[dict[str, Any]]:
        found = [f for p in points for f in track.point(*p)] + list(track.over())
        for state in (self.last, self.runs, self.counts, self.waiting):
            state.clear()
        self._no_timers()
        return found

    def _no_timers(self) -> None:
        if self.idle_ms is not None:  # asking for timers is an error where there are none
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ended = bool(new["gpx_index"].isna().any())
        plain = new[new["gpx_index"].notna()][[c.split()[0] for c in _POINT.split(", ")]].astype(object)
        points = [tuple(None if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) else x for x in p) for p in plain.itertuples(index=False)]
        points = [(int(p[0]), p[1], None if p[2] is None else int(p[2]), *p[3:]) for p in points]
        points = sorted([*self._waiting(), *points], key=lambda p: p[0])
        track, before = self._track(), self._track()
        if ended:
            yield self._rows(key, self._over(track, points))
            return
        later = points[len(points) - self.held :] if self.held else []
        found = [f for p in points[: len(points) - len(later)] for f in track.point(*p)]
        self._keep(track, before)
        if self.held:
            self.waiting.put(later)
        if self.idle_ms is not None:
            self._no_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._rows(key, self._over(self._track(), self._waiting()))

    def close(self) -> None:
        pass


def audit_stream(points: DataFrame, held: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Findings of a streaming frame with track_id, gpx_index, time_raw, lat, lon.

    finding is run (one that ended: kind, start_index, end_index, length, first_ms, max_depth_ms, and its first member as isolated events have it), pair
    (kind: the pair's class; prev_index and gpx_index, dt_sec, dd_meters, time_raw) or count (kind: a temporal class; length: how many points).
    Runs and counts of a track come out at the latest when it is over: when a row with a null gpx_index says so, or, if idle_ms is given,
    when no row came for so many milliseconds. A later row of the same track then begins it anew.

    A track's points are taken in order of gpx_index within a batch; over batches too where none comes later than held points that belong
    behind it: so many are held back. Needs the RocksDB state store (see stream_settings).
    """
    told = timed(points).select("track_id", *(c.split()[0] for c in _POINT.split(", ")))
    mode = "None" if idle_ms is None else "ProcessingTime"
    return told.groupBy("track_id").transformWithStateInPandas(_Audit(held, idle_ms), FINDINGS, "append", mode)


def stream_settings() -> dict[str, str]:
    """What a session needs for audit_stream."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _of(findings: DataFrame, finding: str) -> DataFrame:
    return findings.where(F.col("finding") == finding)


def found_blocks(findings: DataFrame) -> DataFrame:
    """The columns of temporal.blocks()."""
    return _of(findings, "run").where("length > 1").select("track_id", "kind", "start_index", "end_index", "length", "first_ms", "max_depth_ms")


def found_isolated(findings: DataFrame) -> DataFrame:
    """The columns of temporal.isolated()."""
    return _of(findings, "run").where("length = 1").select("track_id", "kind", "gpx_index", "prev_index", "time_raw", "ts_ms", "prev_ms")


def found_pairs(findings: DataFrame) -> DataFrame:
    """The columns of motion.pairs()."""
    return _of(findings, "pair").select("track_id", F.col("prev_index").alias("from_index"), F.col("gpx_index").alias("to_index"), F.col("kind").alias("pair_class"), "dt_sec", "dd_meters", "time_raw")


def found_counts(findings: DataFrame) -> DataFrame:
    """track_id, kind (a temporal class) and n of each track that is over."""
    return _of(findings, "count").select("track_id", "kind", F.col("length").alias("n"))
