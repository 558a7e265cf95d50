"""One-dimensional clustering of a track's time deltas relative to a running median.

Whether a value joins depends on all values before it, so this is the one part that no aggregation expresses. Sorted clustering walks a track's
distinct values with their counts, as Spark counted and sorted them: all copies of a positive value join the same cluster, and how far off each
one joins follows from the median's place among the counts. Sequential clustering takes values as they come and keeps the median of the open
cluster by order statistics. Both are streams of many tracks a task, of which only the open cluster's distinct values are held.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.02
_VALUES = (
    "track_id string, cluster bigint, value double, n bigint, inserted_rel_sum double, inserted_rel_max double, inserted_abs_sum double, inserted_abs_max double, center double"
)


class SortedCluster:
    """Ascending distinct values with counts, and the median's place among them, which only moves up as values are added at the top."""

    def __init__(self, value: float, n: int):
        self.values, self.counts, self.size = [value], [n], n
        self.block, self.before = 0, 0  # the block that holds the lower middle, and how many values lie before it

    def _middle(self, size: int, value: float) -> tuple[float, int]:
        """Median of the first size values, those past the ones here being value; and the largest size up to which it stays the same."""
        low, high = (size - 1) // 2, size // 2
        while self.block < len(self.counts) and self.before + self.counts[self.block] <= low:
            self.before += self.counts[self.block]
            self.block += 1
        if self.block == len(self.counts):
            return value, 1 << 62
        own, end = self.values[self.block], self.before + self.counts[self.block]
        if high < end:
            return own, 2 * end - 1
        above = self.values[self.block + 1] if self.block + 1 < len(self.values) else value
        return (own + above) / 2, size

    def centre(self) -> float:
        return self._middle(self.size, self.values[-1])[0]

    def takes(self, value: float, alpha: float) -> bool:
        centre = self.centre()
        return centre > 0 and abs(value - centre) / centre < alpha

    def add(self, value: float, n: int) -> list[float]:
        """Take n copies of a value above all others, one after another; sums and maxima of how far off they join: relative, then absolute."""
        size, last = self.size, self.size + n
        rel_sum = rel_max = abs_sum = abs_max = 0.0
        while size < last:
            centre, upto = self._middle(size, value)
            k = min(last, upto + 1) - size
            gap = abs(value - centre)
            rel_sum, rel_max, abs_sum, abs_max = rel_sum + k * (gap / centre), max(rel_max, gap / centre), abs_sum + k * gap, max(abs_max, gap)
            size += k
        self.values.append(value)
        self.counts.append(n)
        self.size = last
        return [rel_sum, rel_max, abs_sum, abs_max]


def sorted_clusters(counted: Iterator[tuple[float, int]], alpha: float = ALPHA) -> Iterator[tuple[int, float, int, float, float, float, float, float]]:
    """Of ascending distinct values with counts: cluster, value, count, sums and maxima of how far off the copies joined, the cluster's final centre.
    What is not above 0 has no relative distance: each copy of it is a cluster of its own."""
    cluster, number, rows = None, -1, []

    def closed() -> Iterator[tuple]:
        centre = cluster.centre() if cluster else 0.0
        yield from ((*r, centre) for r in rows)
        rows.clear()

    for value, n in counted:
        if cluster is not None and cluster.takes(value, alpha):
            rows.append((number, value, n, *cluster.add(value, n)))
            continue
        for k in [n] if value > 0 else [1] * n:
            yield from closed()
            cluster, number = SortedCluster(value, k), number + 1
            rows.append((number, value, k, 0.0, 0.0, 0.0, 0.0))
    yield from closed()


class RunningMedian:
    """Median of values as they come: those up to it and those above it in heaps, each distinct value once a heap with how often it is there."""

    def __init__(self):
        self.low, self.high, self.in_low, self.in_high = [], [], {}, {}
        self.n_low = self.n_high = 0

    def _to_low(self, x: float) -> None:
        if x in self.in_low:
            self.in_low[x] += 1
        else:
            self.in_low[x] = 1
            heapq.heappush(self.low, -x)
        self.n_low += 1

    def _to_high(self, x: float) -> None:
        if x in self.in_high:
            self.in_high[x] += 1
        else:
            self.in_high[x] = 1
            heapq.heappush(self.high, x)
        self.n_high += 1

    def add(self, x: float) -> None:
        if not self.n_low or x <= -self.low[0]:
            self._to_low(x)
            if self.n_low > self.n_high + 1:
                y = -self.low[0]
                self.in_low[y] -= 1
                if not self.in_low[y]:
                    del self.in_low[y]
                    heapq.heappop(self.low)
                self.n_low -= 1
                self._to_high(y)
        else:
            self._to_high(x)
            if self.n_high > self.n_low:
                y = self.high[0]
                self.in_high[y] -= 1
                if not self.in_high[y]:
                    del self.in_high[y]
                    heapq.heappop(self.high)
                self.n_high -= 1
                self._to_low(y)

    def middle(self) -> float:
        return -self.low[0] if self.n_low > self.n_high else (-self.low[0] + self.high[0]) / 2


class SequentialClusters:
    """How many clusters values make as they come, each compared with the median of the cluster that is open."""

    def __init__(self, alpha: float = ALPHA):
        self.alpha, self.count, self.open = alpha, 0, None

    def add(self, values: Iterable[float]) -> None:
        for x in values:
            centre = self.open.middle() if self.open else 0.0
            if not self.open or not (centre <= 0 or abs(x - centre) / centre < self.alpha):
                self.count, self.open = self.count + 1, RunningMedian()
            self.open.add(x)


def sequential_count(values: list[float], alpha: float = ALPHA) -> int:
    own = SequentialClusters(alpha)
    own.add(list(values))
    return own.count


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[Any]]]]:
    """Of rows sorted by track: each stretch of one track within a batch, as its id and the other columns."""
    for batch in batches:
        ids, *rest = (c.to_pylist() for c in batch.columns)
        first = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[first]:
                yield ids[first], [c[first:i] for c in rest]
                first = i


_BATCH = 8192


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """track_id, dt_sec and n by track and value, to the rows of _VALUES."""
    names = [c.split()[0] for c in _VALUES.split(", ")]
    types = [pa.string(), pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 5]
    stretches = _stretches(batches)
    ahead = next(stretches, None)
    out: list[tuple] = []

    def track() -> Iterator[tuple[float, int]]:
        """Values of the track that comes next, over as many stretches as it has."""
        nonlocal ahead
        own = ahead[0]
        while ahead is not None and ahead[0] == own:
            yield from zip(*ahead[1], strict=True)
            ahead = next(stretches, None)

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out.clear()
        return done

    while ahead is not None:
        own = ahead[0]
        for row in sorted_clusters(track()):
            out.append((own, *row))
            if len(out) >= _BATCH:
                yield batch()
    if out:
        yield batch()


def _walk_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """track_id and dt_sec in order of place, to track_id and sequential_clusters."""
    track, own, ids, counts = None, None, [], []

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(counts, pa.int64())], ["track_id", "sequential_clusters"])
        ids.clear()
        counts.clear()
        return done

    for name, (values,) in _stretches(batches):
        if own is None or name != track:
            if own is not None:
                ids.append(track)
                counts.append(own.count)
                if len(ids) >= _BATCH:
                    yield batch()
            track, own = name, SequentialClusters()
        own.add(values)
    if own is not None:
        ids.append(track)
        counts.append(own.count)
        yield batch()


def _walk_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """track_id, ascending and dt_sec, of each track its values in order of place and then, ascending, by size, to track_id and how many clusters they
    make both ways."""
    stretches = ((name, ascending, values) for name, (flags, times) in _stretches(batches) for ascending, values in _by_flag(flags, times))
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["track_id", "sorted_clusters", "sequential_clusters"])
        out.clear()
        return done

    for name, track in groupby(stretches, key=itemgetter(0)):
        number, own = -1, SequentialClusters()
        for ascending, part in groupby(track, key=itemgetter(1)):
            values = (v for _, _, vs in part for v in vs)
            if ascending:
                for number, *_ in sorted_clusters((v, sum(1 for _ in same)) for v, same in groupby(values)):
                    pass
            else:
                own.add(values)
        out.append((name, number + 1, own.count))
        if len(out) >= _BATCH:
            yield batch()
    if out:
        yield batch()


def _by_flag(flags: list[bool], values: list[float]) -> Iterator[tuple[bool, list[float]]]:
    """The values of a stretch without the flag, and those with it, which follow."""
    first = bisect_left(flags, True)
    for flag, own in ((False, values[:first]), (True, values[first:])):
        if own:
            yield flag, own


def cluster_counts(deltas: DataFrame) -> DataFrame:
    """track_id, sorted_clusters and sequential_clusters: the numbers of clusters of cluster_values() and sequential_clusters(), of deltas (track_id,
    to_index, dt_sec) that are read once. Each delta is there twice, to be sorted by place and by size."""
    dealt = deltas.select("track_id", "to_index", "dt_sec").repartition("track_id")
    twice = dealt.select("track_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("ascending"), "to_index", "dt_sec")
    placed = twice.withColumn("place", F.when(~F.col("ascending"), F.col("to_index"))).drop("to_index").sortWithinPartitions("track_id", "ascending", "place", "dt_sec")
    return placed.select("track_id", "ascending", "dt_sec").mapInArrow(_walk_both, "track_id string, sorted_clusters bigint, sequential_clusters bigint")


def cluster_values(deltas: DataFrame) -> DataFrame:
    """Of deltas (track_id, dt_sec), a row per distinct value of each track: its cluster, n copies, how far off these joined (sums and maxima), and
    the cluster's final centre. Copies are counted before tracks are sorted."""
    counted = deltas.groupBy("track_id", "dt_sec").agg(F.count(F.lit(1)).alias("n"))
    return counted.repartition("track_id").sortWithinPartitions("track_id", "dt_sec").mapInArrow(_walk, _VALUES)


def cluster_numbers(deltas: DataFrame) -> DataFrame:
    """deltas with cluster and center, the final centre of that cluster, of each one."""
    own = cluster_values(deltas).where("value > 0").select("track_id", F.col("value").alias("dt_sec"), "cluster", "center")
    return deltas.join(own, ["track_id", "dt_sec"])


def sequential_clusters(deltas: DataFrame) -> DataFrame:
    """track_id and the number of its clusters when deltas (track_id, to_index, dt_sec) are taken in order of to_index."""
    own = deltas.select("track_id", "to_index", "dt_sec").repartition("track_id").sortWithinPartitions("track_id", "to_index")
    return own.select("track_id", "dt_sec").mapInArrow(_walk_in_order, "track_id string, sequential_clusters bigint")


def descriptors(values: DataFrame) -> DataFrame:
    """A row per cluster of each track, from cluster_values()."""
    off = F.abs(F.col("value") - F.col("center"))
    rel = F.when(F.col("center") > 0, off / F.col("center")).otherwise(0.0)
    n = F.col("n")
    each = lambda x: F.sum(x) / F.sum(n)
    g = values.groupBy("track_id", "cluster").agg(
        F.first("center").alias("centerSec"), F.sum(n).alias("count"), F.min("value").alias("minSec"), F.max("value").alias("maxSec"),
        each("inserted_rel_sum").alias("meanInsertionRelativeDeviation"), F.max("inserted_rel_max").alias("maxInsertionRelativeDeviation"),
        each("inserted_abs_sum").alias("meanInsertionAbsoluteDeviationSec"), F.max("inserted_abs_max").alias("maxInsertionAbsoluteDeviationSec"),
        each(off * n).alias("finalMeanAbsoluteDeviationSec"), F.max(off).alias("finalMaxAbsoluteDeviationSec"),
        each(rel * n).alias("finalMeanRelativeDeviation"), F.max(rel).alias("finalMaxRelativeDeviation"),
    )
    total = F.sum("count").over(Window.partitionBy("track_id"))  # over clusters: values are walked once
    spread = F.col("maxSec") - F.col("minSec")
    return g.withColumn("total", total).select(
        "track_id", F.col("cluster").cast("int").alias("cluster"), "centerSec", "count", (F.col("count") / F.col("total")).alias("clusterShareOfTotalDeltas"), "minSec", "maxSec", spread.alias("spreadSec"),
        "meanInsertionRelativeDeviation", "maxInsertionRelativeDeviation", "meanInsertionAbsoluteDeviationSec", "maxInsertionAbsoluteDeviationSec", "finalMeanAbsoluteDeviationSec", "finalMaxAbsoluteDeviationSec",
        "finalMeanRelativeDeviation", "finalMaxRelativeDeviation", F.when(F.col("centerSec") > 0, spread / F.col("centerSec")).otherwise(0.0).alias("finalSpreadOverCenterRatio"),
    )
