"""Clusters of deltas against a plain walk that sorts what it holds for every value."""

import math
import random
import statistics
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayscope.operators import clustering
from wayscope.operators.clustering import ALPHA, RunningMedian, sequential_count, sorted_clusters


def plain_sorted(values):
    """(cluster, value, relative and absolute distance at joining) of each value."""
    out, own = [], []
    for v in sorted(values):
        centre = statistics.median(own) if own else 0
        gap = abs(v - centre)
        if centre > 0 and gap / centre < ALPHA:
            own.append(v)
            out.append((out[-1][0], v, gap / centre, gap))
        else:
            own = [v]
            out.append((out[-1][0] + 1 if out else 0, v, 0.0, 0.0))
    return out


def plain_sequential(values):
    n, own = 0, []
    for v in values:
        centre = statistics.median(own) if own else 0
        if own and (centre <= 0 or abs(v - centre) / centre < ALPHA):
            own.append(v)
        else:
            n, own = n + 1, [v]
    return n


VALUES = st.lists(st.sampled_from([0.0, 1.0, 1.001, 1.015, 1.019, 1.02, 1.021, 1.03, 1.04, 1.05, 2.0, 2.02, 2.05]) | st.floats(0.9, 1.1), max_size=60)


@settings(max_examples=500, deadline=None)
@given(VALUES)
def test_sorted(values):
    want = {}
    for number, v, rel, gap in plain_sorted(values):
        own = want.setdefault((number, v), [0, 0.0, 0.0, 0.0, 0.0])
        want[number, v] = [own[0] + 1, own[1] + rel, max(own[2], rel), own[3] + gap, max(own[4], gap)]
    members = {}
    for number, v, *_ in plain_sorted(values):
        members.setdefault(number, []).append(v)
    got = list(sorted_clusters(iter(sorted(Counter(values).items()))))
    assert [(r[0], r[1]) for r in got] == sorted(want)
    for number, v, n, *off, centre in got:
        assert n == want[number, v][0] and off == pytest.approx(want[number, v][1:], abs=1e-12) and centre == statistics.median(members[number])


@settings(max_examples=500, deadline=None)
@given(VALUES)
def test_sequential(values):
    assert sequential_count(values) == plain_sequential(values)
    own = RunningMedian()
    for i, v in enumerate(values):
        own.add(v)
        assert own.middle() == statistics.median(values[: i + 1])


def test_by_hand():
    got = list(sorted_clusters(iter([(10.0, 1), (10.1, 1), (10.25, 1), (10.9, 1), (20.0, 1)])))
    assert [r[0] for r in got] == [0, 0, 0, 1, 2] and math.isclose(got[2][5], 0.2) and got[3][3] == 0
    assert sequential_count([10.0, 20.0, 10.0, 10.1, 20.0]) == 4 and sequential_count([]) == 0


def test_one_open_cluster_of_millions():
    """Work grows with n log n, and what is held with the distinct values."""
    rng = random.Random(4)
    values = [1 + rng.randrange(1000) / 100_000 for _ in range(1_000_000)]
    began = time.process_time()
    own = clustering.SequentialClusters()
    own.add(values)
    assert own.count == 1 and len(own.open.low) + len(own.open.high) <= 1001
    (row,) = sorted_clusters(iter([(5.0, 10**12)]))
    assert row == (0, 5.0, 10**12, 0.0, 0.0, 0.0, 0.0, 5.0)
    assert time.process_time() - began < 60


def test_tracks_over_batches(spark):
    """Tracks whose rows come in several batches, in one task and in many."""
    rng = random.Random(6)
    rows = [(f"t{t}", i, round(rng.choice([1, 1.01, 1.03, 5]) + rng.randrange(9) / 1000, 3)) for t in range(9) for i in range(rng.randint(1, 300))]
    by_track = {}
    for t, _, v in rows:
        by_track.setdefault(t, []).append(v)
    deltas = spark.createDataFrame(rows, "track_id string, to_index long, dt_sec double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        seq = {r.track_id: r.sequential_clusters for r in clustering.sequential_clusters(deltas).collect()}
        numbers = sorted((r.track_id, r.to_index, r.cluster) for r in clustering.cluster_numbers(deltas).collect())
        n = {r.track_id: r.n for r in clustering.cluster_values(deltas).groupBy("track_id").agg(F.sum("n").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seq == {t: plain_sequential(v) for t, v in by_track.items()} and n == {t: len(v) for t, v in by_track.items()}
    of = {t: {v: k for k, v, *_ in plain_sorted(vs)} for t, vs in by_track.items()}
    assert numbers == sorted((t, i, of[t][v]) for t, i, v in rows)
    empty = deltas.limit(0)
    assert clustering.cluster_values(empty).count() == clustering.sequential_clusters(empty).count() == clustering.cluster_numbers(empty).count() == 0


def test_both_counts_in_one_stream(spark, tmp_path):
    """Numbers of clusters both ways, of tracks over many batches, are those of two streams; metrics of tracks read points three times."""
    from wayscope.plans import track_metrics

    rng = random.Random(21)
    rows = [(f"t{t}", i, i + 1, rng.choice([1.0, 1.01, 1.02, 2.0, 2.05, rng.uniform(0.5, 3)])) for t in range(5) for i in range(1 + 90 * t)] + [(None, 0, 1, 2.0), (None, 1, 2, 5.0)]
    rng.shuffle(rows)
    deltas = spark.createDataFrame(rows, "track_id string, from_index long, to_index long, dt_sec double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.track_id: (r.sorted_clusters, r.sequential_clusters) for r in clustering.cluster_counts(deltas).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_size = {r.track_id: r.n for r in clustering.cluster_values(deltas).groupBy("track_id").agg((F.max("cluster") + 1).alias("n")).collect()}
    by_place = {r.track_id: r.sequential_clusters for r in clustering.sequential_clusters(deltas).collect()}
    assert got == {t: (by_size[t], by_place[t]) for t in by_size} and len(got) == 6
    assert clustering.cluster_counts(deltas.limit(0)).count() == 0
    found = [("a", "a.gpx", 0, "trkpt", "1", "2", None, None, None)]
    spark.createDataFrame(found, "track_id string, file_name string, gpx_index long, point_type string, raw_lat string, raw_lon string, raw_ele string, raw_time string, extensions string").write.parquet(str(tmp_path / "found"))
    assert track_metrics(spark.read.parquet(str(tmp_path / "found")))._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
