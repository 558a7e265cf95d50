"""What keeps one long track from being one task's work or all pairs: nearest points, exact medians, densities, against brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscope.operators import density, ingest, sampling
from wayscope.operators.classify import classify
from wayscope.operators.medians import exact_medians
from wayscope.operators.nearest import CELL_POINTS, boxed, levels_for, nearest_point


def nearest_by_hand(points, probes):
    out = {}
    for probe, track, lat, lon in probes:
        own = [p for p in points if p[0] == track and p[2] is not None]
        if own and lat is not None:
            out[probe] = min(own, key=lambda p: ((p[2] - lat) ** 2 + (p[3] - lon) ** 2, p[1]))[1]
    return out


@pytest.mark.parametrize("levels", [0, 1, 2, None])
def test_nearest(spark, levels):
    rng = random.Random(7)
    points = [("a", i, rng.gauss(0, 1), rng.gauss(0, 9)) for i in range(700)] + [("a", 700 + i, 0.5, 0.5) for i in range(5)]
    points += [("line", i, 10.0, i / 7) for i in range(60)] + [("one", 3, 1.0, 1.0), ("one", 9, None, 1.0), ("grid", 0, 0.0, 0.0), ("grid", 1, 0.0, 2.0), ("grid", 2, 2.0, 0.0)]
    rng.shuffle(points)
    probes = [(f"p{i}", rng.choice(["a", "line", "one", "none"]), rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(300)]
    probes += [("tie", "grid", 1.0, 1.0), ("same", "a", 0.5, 0.5), ("far", "a", 5000.0, -5000.0), ("null", "a", None, 1.0)]
    got = nearest_point(spark.createDataFrame(points, "track_id string, gpx_index long, lat double, lon double"), spark.createDataFrame(probes, "probe_id string, track_id string, lat double, lon double"), levels)
    rows = got.collect()
    assert {r.probe_id: r.gpx_index for r in rows} == nearest_by_hand(points, probes) and len(rows) == len({r.probe_id for r in rows})


def test_probes_meet_few_points(spark):
    """Probes all over and far from one track: what the last step compares is a small share of all pairs."""
    n, m = 60_000, 2_000
    points = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("gpx_index"), (F.rand(1) * 90).alias("lat"), (F.randn(2) * 20).alias("lon"))
    probes = spark.range(m).select(F.col("id").alias("probe_id"), F.lit("t").alias("track_id"), (F.rand(3) * 200 - 100).alias("lat"), (F.randn(4) * 60).alias("lon"))
    got = nearest_point(points.cache(), probes.cache())
    rows = {r.probe_id: r.gpx_index for r in got.collect()}
    p = points.toPandas()
    for r in probes.limit(300).collect():
        d = (p.lat - r.lat) ** 2 + (p.lon - r.lon) ** 2
        assert rows[r.probe_id] == p.gpx_index[d.idxmin()]
    assert levels_for(n) == 2 and levels_for(CELL_POINTS) == 0 and levels_for(50_000_000) == 3


@pytest.mark.parametrize("rounds", [0, 1, 2, 5, None])
def test_medians(spark, rounds):
    rng = random.Random(9)
    groups = {
        "odd": [rng.gauss(0, 1e3) for _ in range(501)], "even": [rng.uniform(-1, 1) for _ in range(500)], "equal": [4.25] * 300, "two": [1.0, 2.0], "one": [-3.5],
        "powers": [2.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(400)], "zeros": [0.0, -0.0, 0.0, 1e-300, -1e-300], "close": [1 + k * 2.0**-52 for k in range(301)],
        "ends": [math.inf, -math.inf, 1.0, 2.0, 3.0], "half": [0.0] * 200 + [7.0] * 200,
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("odd", None), ("none", None), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    rng.shuffle(rows)
    got = {r.g: (r.n, r.median) for r in exact_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", rounds).collect()}
    want = {g: (len(xs), statistics.median(xs)) for g, xs in groups.items()} | {"nan": (3, 2.0)}
    assert got == want


def test_density_over_batches(spark):
    """Partial sums of a track whose values come in many batches and tasks give the density of all of them."""
    rng = random.Random(10)
    by_track = {"a": [rng.lognormvariate(0, 1) for _ in range(900)], "b": [2.0] * 40, "c": [5.0], "d": [1.0, 1.0, 3.0]}
    values = spark.createDataFrame([(t, x) for t, xs in by_track.items() for x in xs], "track_id string, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = density.kde(values, "v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    widths = {r.track_id: r.h for r in density.bandwidth(values, "v").collect()}
    assert len(rows) == 4 * density.GRID
    for t, xs in by_track.items():
        logs, h = np.log(xs), widths[t]
        at = logs.min() + (logs.max() - logs.min()) * np.arange(density.GRID) / (density.GRID - 1)
        want = np.exp(-0.5 * ((at[:, None] - logs) / h) ** 2).sum(axis=1) / (len(xs) * h * math.sqrt(2 * math.pi))
        got = [r.y for r in sorted((r for r in rows if r.track_id == t), key=lambda r: r.grid_i)]
        assert got == pytest.approx(list(want), rel=1e-9)


def test_densities_make_no_grid_rows_to_shuffle(spark):
    """Sums over the grid are a row per track: values are exchanged, grid points never are, and each density is worked out once."""
    values = spark.createDataFrame([("a", float(i % 7 + 1)) for i in range(50)], "track_id string, v double")
    distances, times = values.withColumnRenamed("v", "dd_meters"), values.withColumnRenamed("v", "dt_sec")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (density.kde(values, "v"), density.kde_peaks(values, "v")):
        assert plan(df).index("Exchange") > plan(df).index("MapInArrow") and plan(df).count("MapInArrow") == 1
    for df in (density.overview(times, distances), density.curves(times, distances)):
        assert plan(df).count("MapInArrow") == 2
    whole = density.kde(values, "v").cache()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(density.kde_peaks(values, "v").collect()) == key(density.peaks(whole).collect()) != []


def test_density_charts_read_points_once(spark, tmp_path):
    """Both kinds of values come from one reading of the points, with the results of two."""
    rng = random.Random(12)
    rows = [(t, i, "trkpt", 1 + rng.random() * (t != "still"), 2.0, None, None if t == "timeless" else f"2024-01-01T00:{rng.randint(0, 59):02}:00Z", None) for t in ("a", "b", "timeless", "still", None) for i in range(40)]
    found = spark.createDataFrame([*rows, ("one", 0, "trkpt", 1.0, 1.0, None, None, None)], "track_id string, gpx_index long, point_type string, lat double, lon double, ele double, time_raw string, extensions string")
    found.write.parquet(str(tmp_path / "points"))
    c = classify(spark.read.parquet(str(tmp_path / "points")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted(map(repr, rows))
    times, distances = sampling.time_deltas(c), sampling.primary_distances(c)
    for once, twice in ((density.series_overview, density.overview), (density.series_curves, density.curves)):
        ours = once(sampling.series(c))
        assert [plan(ours).count(x) for x in ("FileScan", "MapInArrow", "Exchange", "Join")] == [1, 1, 1, 0]
        assert key(_whole(ours)) == key(_whole(twice(times, distances)))
    assert plan(distances).count("FileScan") == plan(distances).count("Exchange") == 1
    got = {r.track_id: r for r in density.series_overview(sampling.series(c)).collect()}
    assert set(got) == {"a", "b", "timeless", "still", None} and got["timeless"].time_bandwidth is None and got["still"].distance_bandwidth == got[None].distance_bandwidth == 1.0
    moved = {t: {r.to_index for r in distances.where(F.col("track_id") == t).collect()} for t in ("a", "timeless")}
    assert moved["timeless"] == set(range(1, 40)) and moved["a"] < moved["timeless"]


def _whole(df):
    """Rows with doubles to ten figures, as sums may be added in another order."""
    plain = lambda x: float(f"{x:.9e}") if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x
    return [plain(tuple(r)) for r in df.select(*sorted(df.columns)).collect()]


def test_filters_parse_a_coordinate_once(spark):
    """Filters move below the parsing; a coordinate named again there is parsed again."""
    found = spark.createDataFrame([("a", 0, "trkpt", "1.5", "x", None, None, None)], "track_id string, gpx_index long, point_type string, raw_lat string, raw_lon string, raw_ele string, raw_time string, extensions string")
    plan = ingest.points(found)._jdf.queryExecution().optimizedPlan().toString()
    where = next(line for line in plan.split("\n") if "Filter" in line)
    assert where.count("regexp_extract(raw_lat") <= 2 and "must be" not in where
    odd = [("90", "180"), ("-90", "-180"), ("90.1", "0"), ("0", "-180.5"), ("NaN", "0"), ("Infinity", "1"), ("1", "-Infinity"), ("", "1"), (None, "1"), ("1", None), ("  7x", "8")]
    rows = [("a", i, "trkpt", lat, lon, None, " ﻿ t \n", None) for i, (lat, lon) in enumerate(odd)]
    frame = spark.createDataFrame(rows, found.schema)
    assert sorted(r.gpx_index for r in ingest.points(frame).collect()) == [0, 1, 10]
    assert {r.time_raw for r in ingest.points(frame).collect()} == {"t"}
    assert sorted(r.gpx_index for r in ingest.rejected(frame).collect()) == [2, 3, 4, 5, 6, 7, 8, 9]


def test_coordinates_are_parsed_once(spark):
    """Filters on coordinates, and whatever else reads them, take what was parsed; no text is read a second time."""
    found = spark.createDataFrame([("a", 0, "trkpt", "1.5", "x", None, None, None)], "track_id string, gpx_index long, point_type string, raw_lat string, raw_lon string, raw_ele string, raw_time string, extensions string")
    for df in (ingest.points(found), ingest.counts(found)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(raw_lat") == plan.count("regexp_extract(raw_lon") == 1


def test_nearest_of_boxed_points(spark, tmp_path):
    """Points that carry their track's box are read by cells and by the last step alone."""
    rng = random.Random(13)
    points = [(t, i, rng.gauss(0, 1), rng.gauss(0, 9)) for t in ("a", "b") for i in range(300)] + [("one", 3, 1.0, 1.0), ("one", 9, None, 1.0), ("one", 10, 40.0, None), ("none", 1, None, None), (None, 1, 1.0, 1.0)]
    probes = [(f"p{i}", rng.choice(["a", "b", "one", "none"]), rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(100)]
    spark.createDataFrame(points, "track_id string, gpx_index long, lat double, lon double").write.parquet(str(tmp_path / "points"))
    own = spark.read.parquet(str(tmp_path / "points"))
    asked = spark.createDataFrame(probes, "probe_id string, track_id string, lat double, lon double")
    for levels in (0, 1, 2):
        got, plain = nearest_point(boxed(own), asked, levels), nearest_point(own, asked, levels)
        assert {r.probe_id: r.gpx_index for r in got.collect()} == nearest_by_hand([p for p in points if p[3] is not None], probes)
        scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
        assert scans(got) == levels + 1 and scans(plain) == 2 * scans(got)


def test_medians_read_values_once_a_round(spark):
    """The first histogram tells sizes as well, so that no pass counts alone."""
    values = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", math.nan), ("b", -1.0), ("b", None)], "g string, v double")
    got = exact_medians(values, ["g"], "v", 2)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    rows = {r.g: (r.n, r.median) for r in got.collect()}
    assert rows["a"] == (9, 4.0) and rows["b"][0] == 2 and math.isnan(rows["b"][1])
