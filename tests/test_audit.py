"""Window forms against a plain state machine, rules that documents keep, and edges that no golden document has."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayscope.functions import clock, epoch_ms, haversine, js_number, parse_float
from wayscope.operators import clustering, density, drill, ingest, motion, nearest, sampling, temporal
from wayscope.operators.classify import classify
from wayscope.plans import audit_documents, delta_documents, metrics, prevalence, to_json_rows
from wayscope.schemas import FOUND, KINDS
from wayscope.sources import found_points, linear_track, malformed_files, to_gpx
from wayscope.streaming import classify_stream


def random_tracks(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        for i in range(rng.randint(1, 25)):
            x = rng.random()
            time = None if x < 0.2 else "junk" if x < 0.35 else f"2026-01-01T00:00:{rng.randint(0, 9):02d}Z"
            rows.append((f"t{t}", f"t{t}.gpx", i, "trkpt", "bad" if rng.random() < 0.05 else f"{rng.uniform(-80, 80):.5f}", f"{rng.uniform(-170, 170):.5f}", None, time, None))
    return rows


def machine(points):
    """Runs of each kind, and each point's class, walked point by point; points: (index, ms or None, missing)."""
    classes, runs, open_ = [], [], {}
    anchor = last = None

    def close(kind):
        if kind in open_:
            runs.append((kind, *open_.pop(kind)))

    for index, ms, missing in points:
        depth = None
        if missing:
            kind = "missing"
        elif ms is None:
            kind = "unparsable"
        elif last is None:
            kind = "first"
        elif ms == last:
            kind = "duplicate"
        elif ms >= anchor:
            kind = "forward"
        else:
            kind, depth = "backtracking", anchor - ms
        if kind != "missing":
            close("missing")
        if ms is not None:
            close("unparsable")
        if kind in ("forward", "backtracking"):
            close("duplicate")
        if kind == "forward":
            close("backtracking")
        if kind in KINDS:
            a, _, n, d = open_.get(kind, (index, index, 0, None))
            open_[kind] = (a, index, n + 1, depth if d is None else max(d, depth or 0))
        if ms is not None:
            anchor, last = ms if anchor is None else max(anchor, ms), ms
        classes.append((index, kind, depth))
    for kind in list(open_):
        close(kind)
    return classes, runs


def states(rows):
    tracks = {}
    for t, _, i, _, lat, _, _, time, _ in rows:
        tracks.setdefault(t, [])
        if lat != "bad":
            tracks[t].append((i, int(time[-3:-1]) * 1000 if time and time != "junk" else None, time is None))
    return tracks


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(random_tracks(), FOUND).repartition(4).cache()


@pytest.fixture(scope="module")
def classified(found):
    return classify(ingest.points(found)).cache()


def test_classes_and_runs(classified):
    want = {t: machine(p) for t, p in states(random_tracks()).items()}
    got = {(r.track_id, r.gpx_index): (r.temporal_class, r.depth_ms) for r in classified.collect()}
    assert got == {(t, i): (k, d) for t, (c, _) in want.items() for i, k, d in c}
    runs = {(r.track_id, r.kind, r.start_index, r.end_index, r.length, r.max_depth_ms) for r in temporal.runs(classified).collect()}
    assert runs == {(t, *r) for t, (_, rs) in want.items() for r in rs}


def test_stream_gives_the_same_classes(spark, classified, found, tmp_path):
    ingest.points(found).select("track_id", "gpx_index", "time_raw").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track_id string, gpx_index bigint, time_raw string").parquet(str(tmp_path / "in"))
    query = classify_stream(stream).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.track_id, r.gpx_index): (r.temporal_class, r.dt_ms, r.depth_ms) for r in spark.table("online").collect()}
    assert got == {(r.track_id, r.gpx_index): (r.temporal_class, r.dt_ms, r.depth_ms) for r in classified.collect()}


def test_documents_keep_their_rules(found):
    docs = {r.track_id: json.loads(r.json)["audit"] for r in to_json_rows(audit_documents(found)).collect()}
    assert set(docs) == {r[0] for r in random_tracks()}
    for d in docs.values():
        t, s, m = d["temporal"], d["sampling"], d["motion"]
        order = t["temporalOrder"]
        for k in KINDS:
            assert order[k]["pointCount"] == order[k]["isolatedPointCount"] + sum(b["length"] for b in order[k]["blocks"])
        assert s["time"]["timestampContext"]["timestampedPointsCount"] == t["session"]["parseableTimestampPointCount"]
        n = m["rejections"]
        assert m["evaluatedPairs"]["consecutivePairCount"] == m["evaluatedPairs"]["forwardValidPairCount"] + sum(v for k, v in n.items() if k != "events")
        assert all(c["maxInsertionRelativeDeviation"] < clustering.ALPHA for c in s["time"]["clustering"]["clusters"])


def test_parsing(spark):
    texts = ["1.5abc", "", "  -2e1x", "Infinity", ".5.", "abc", None, "+7", "1.5d"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(parse_float(F.col("x"))).collect()]
    assert got == [1.5, None, -20.0, math.inf, 0.5, None, None, 7.0, 1.5]
    times = ["2026-01-01", "2026-01-01T00:00:00.123456Z", "2026-01-01T05:30:00+05:30", "12:30", "T12:00:00", "2026-13-01T00:00:00Z", "1 Jan 2026", "2026-01-01T00:00:01"]
    base = 1767225600000
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(times)], "i int, x string").orderBy("i").select(epoch_ms(F.col("x"))).collect()]
    assert got == [base, base + 123, base, None, None, None, None, base + 1000]
    r = spark.range(1).select(clock(F.lit(base), "Asia/Kolkata"), js_number(F.lit(95.0)), js_number(F.lit(-91.25))).first()
    assert tuple(r) == ("05:30:00", "95", "-91.25")


def test_rejections(spark):
    row = lambda lat, lon: ("a", "a.gpx", 0, "wpt", lat, lon, "x", " ", None)
    d = spark.createDataFrame([row("90", "-180"), row("90.1", "0"), row("Infinity", "0"), row(None, "1"), row("1x", "180.0")], FOUND)
    reasons = [r.reason for r in ingest.checked(d).collect()]
    assert reasons[0] is None and reasons[4] is None
    assert reasons[1] == "Coordinates out of valid range or non-finite: lat=90.1 (must be -90 to 90), lon=0 (must be -180 to 180)"
    assert "lat=Infinity" in reasons[2] and reasons[3] == 'Invalid coordinates: lat="null", lon="1" (not parseable as numbers)'
    p = ingest.points(d).collect()
    assert all(x.ele is None and x.time_raw is None for x in p)


def test_gpx_in_and_out(spark):
    xml = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk/><trk><trkseg><trkpt lat="3" lon="4"/></trkseg><trkseg/></trk><rte/><rte><rtept lat="2"/></rte><wpt lat="1" lon="1"><ele>5</ele><time> 2026-01-01T00:00:00Z </time></wpt></gpx>'
    raw = spark.createDataFrame([("a", "a.gpx", xml), ("b", "b.gpx", "<gpx></gpx>")], "track_id string, file_name string, xml string")
    for strict in (False, True):
        got = [(r.track_id, r.gpx_index, r.point_type, r.raw_lat, r.raw_lon, r.raw_ele, r.raw_time) for r in found_points(raw, strict).orderBy("gpx_index").collect()]
        assert got == [("a", 0, "wpt", "1", "1", "5", "2026-01-01T00:00:00Z"), ("a", 1, "rtept", "2", None, None, None), ("a", 2, "trkpt", "3", "4", None, None)]
    docs = audit_documents(found_points(raw), raw)
    assert {r.track_id: r.total_points for r in metrics(docs).collect()} == {"a": 3, "b": 0}
    empty = json.loads(to_json_rows(docs.where("track_id = 'b'")).first().json)["audit"]
    assert empty["temporal"]["session"] == {"rawSessionDurationSec": None, "parseableTimestampPointCount": 0} and empty["sampling"]["time"]["normalization"] is None
    assert empty["motion"]["speed"]["meanSpeedMps"] is None and empty["motion"]["distance"] == {"totalForwardValidDistanceMeters": 0.0} and empty["temporal"]["temporalOrder"]["backtracking"]["blocks"] == []
    with pytest.raises(Exception):  # noqa: B017
        found_points(spark.createDataFrame([("c", "c.gpx", "<gpx><trk>")], raw.schema)).collect()
    line = linear_track(spark, "x", 5, (1.0, 2.0), (0.1, 0.1), 0, 2)
    again = found_points(to_gpx(line))
    assert [(r.raw_lat, r.raw_time) for r in again.orderBy("gpx_index").collect()] == [(r.raw_lat, r.raw_time) for r in line.orderBy("gpx_index").collect()]


def test_antipodes_are_guarded(spark):
    rng = random.Random(7)
    pairs = [(i, a := rng.uniform(-90, 90), b := rng.uniform(-180, 0), -a, b + 180) for i in range(2000)]
    d = spark.createDataFrame(pairs, "i int, a double, b double, c double, d double").select(haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"))
    assert d.where(~F.isnan("m") & (F.abs(F.col("m") - 20015086.8) > 1)).count() == 0


def test_drill(spark, found):
    p = spark.createDataFrame([("a", i, "trkpt", 0.0, i / 10, None, f"2026-01-01T00:00:{i:02d}Z", None) for i in range(10)] + [("b", 99, "trkpt", 1.0, 1.0, None, None, None)], "track_id string, gpx_index bigint, point_type string, lat double, lon double, ele double, time_raw string, extensions string")
    got = {r.track_id: r for r in drill.local_block(p, 2, 5).collect()}
    assert (got["a"].points, got["a"].elapsed_sec) == (4, 3.0) and math.isclose(got["a"].cumulative_m, got["a"].displacement_m, rel_tol=1e-6)
    assert tuple(got["b"])[1:] == (0.0, 0.0, 0, None)
    probes = spark.createDataFrame([("p", "a", 0.0, 0.25), ("q", "b", 0.0, 0.0)], "probe_id string, track_id string, lat double, lon double")
    assert {r.probe_id: r.gpx_index for r in nearest.nearest_point(p, probes).collect()} == {"p": 2, "q": 99}
    assert {r.track_id: r.max_lon for r in drill.neighbourhood(p, 5, 2).collect()} == {"a": 0.7}
    assert [len(r.route) for r in drill.polyline(p).orderBy("track_id").collect()] == [10, 1]


def test_density(spark):
    d = spark.createDataFrame([("a", float(x)) for x in [1, 1, 1, 1.1, 8, 8, 9]] + [("b", 3.0), ("c", -1.0), ("c", float("nan"))], "track_id string, v double")
    h = {r.track_id: r.h for r in density.bandwidth(d, "v").collect()}
    assert set(h) == {"a", "b"} and math.isclose(h["b"], 1.06)
    curve = density.kde(d, "v", h=0.1).cache()
    assert curve.where("track_id = 'a'").count() == density.GRID
    area = curve.where("track_id = 'a'").selectExpr("sum(y) * (max(x_log) - min(x_log)) / 199").first()[0]
    assert 0.4 < area < 1.0
    assert density.peaks(curve).where("track_id = 'a'").count() >= 1
    plain = {(r.track_id, r.grid_i): r.y for r in density.kde(d, "v").collect()}
    assert {(r.track_id, r.grid_i): r.y for r in density.kde(d, "v", option=0.0).collect()} == plain  # 0: none given
    given = {(r.track_id, r.grid_i): r.y for r in density.kde(d, "v", option=math.exp(0.1)).collect()}
    assert all(math.isclose(given[r.track_id, r.grid_i], r.y, rel_tol=1e-9) for r in curve.collect())
    assert all(math.isnan(r.y) for r in density.kde(d, "v", option=1.0).collect())
    pairs = spark.createDataFrame([("a", i, i + 1, 1.0, float(i)) for i in range(300)], "track_id string, from_index bigint, to_index bigint, dt_sec double, dd_meters double")
    shown = density.sequence_window(pairs, 290).collect()
    assert len(shown) == 200 and min(r.pos for r in shown) == 100 and max(r.shade for r in shown) == 1.0
    assert {round(r.meters) for r in density.legend(pairs).collect()} == {0, 3, 16, 71, 299}
    assert [r.label for r in density.legend_labels(pairs).orderBy("share").collect()] == ["0 m", "~3 m", "~16 m", "~71 m", "299 m"]
    still = pairs.where("dd_meters = 0")
    assert [(r.share, r.meters, r.label) for r in density.legend_labels(still).collect()] == [(0.0, 0.0, "0 m")]
    shown = spark.createDataFrame([(12.5,), (0.256,), (0.0,)], "x double").select(density.tick(F.col("x")), density.tick(F.col("x"), about=True)).collect()
    assert [tuple(r) for r in shown] == [("13", "~13"), ("0.26", "~0.26"), ("0", "0")]


def test_chart_bounds_by_hand(spark):
    line = spark.createDataFrame([(t, float(i), i / 199) for t in "abc" for i in range(200)], "track_id string, grid_i double, x_log double")
    h = spark.createDataFrame([("a", 0.5), ("b", 0.01), ("c", 0.1)], "track_id string, h double")
    got = {r.track_id: (r.low, r.high, r.step) for r in density.bandwidth_range(line, h).collect()}
    want = {"a": (0.02, 1.0, 0.00098), "b": (0.005, 0.2, 0.000195), "c": (0.02, 0.2, 0.00018)}
    assert all(math.isclose(x, y, rel_tol=1e-12) for t in want for x, y in zip(got[t], want[t], strict=True))
    pairs = spark.createDataFrame([("a", 2.0, 8.0), ("a", 4.0, 0.0), ("a", 16.0, 8.0)], "track_id string, dt_sec double, dd_meters double")
    r = density.domains(pairs).first()
    assert (r.min_dt_sec, r.min_dd_meters) == (math.log(1e-10),) * 2 and math.isclose(r.max_dt_sec, math.log(16)) and math.isclose(r.max_dd_meters, math.log(8))
    assert [r.dt_sec for r in density.viewport(pairs, (0.0, 2.0), (2.0, 3.0)).collect()] == [2.0]
    deltas = spark.createDataFrame([("t", 1.0)], "track_id string, dt_sec double")
    r = density.overview(deltas, deltas.limit(0).withColumnRenamed("dt_sec", "dd_meters")).first()
    assert math.isclose(r.time_bandwidth, math.exp(1.06)) and (r.distance_bandwidth, r.time_peaks, r.distance_peaks) == (1.0, 0, 0)
    r = density.curves(deltas, deltas.limit(0).withColumnRenamed("dt_sec", "dd_meters")).first()
    assert len(r.time_curve) == density.GRID and r.distance_curve == r.distance_tops == []


def test_text_edges_by_hand(spark):
    numbers = {0.0001: "0.0001", 12345678.5: "12345678.5", 1e-7: "1e-7", 1.5e21: "1.5e+21", 1e20: "100000000000000000000", -0.1: "-0.1", 0.30000000000000004: "0.30000000000000004", -1.25e-9: "-1.25e-9", 90.0: "90", 0.0: "0", 1e-6: "0.000001"}
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(js_number(F.col("x"))).collect()]
    assert got == list(numbers.values())
    row = lambda i, time: ("a", "a.gpx", i, "trkpt", "1", "2", None, time, None)
    d = spark.createDataFrame([row(0, "\t"), row(1, "\t2026-01-01T00:00:00Z\n"), row(2, "\u00a0\ufeff"), row(3, None)], FOUND)
    assert [(r.time_raw, r.ts_state) for r in classify(ingest.points(d)).orderBy("gpx_index").collect()] == [(None, "missing"), ("2026-01-01T00:00:00Z", "valid"), (None, "missing"), (None, "missing")]
    assert [drill.block_edge(x) for x in ("12", " 7x", "-3", "x", "", None, "4.9")] == [12, 7, -3, 0, 0, 0, 4]
    one = spark.createDataFrame([("a", 0, "trkpt", 1.0, 2.0, None, "2026-01-01T00:00:00Z", None)], "track_id string, gpx_index bigint, point_type string, lat double, lon double, ele double, time_raw string, extensions string")
    block = drill.local_block(one, 0, 5)
    assert block.first().elapsed_sec is None and block.first().points == 1
    assert drill.block_text(block).first().text == "cumulativeDistanceM: 0.00\nnetDisplacementM: 0.00\npointCount: 1\nelapsedTimeSec: null"


def test_gpx_writes_every_kind_and_reads_extensions(spark):
    rows = [("a", "a.gpx", i, k, str(i), "2", None, 'x<y&"z', "<hr>1</hr>" if i == 3 else None) for i, k in enumerate(("wpt", "rtept", "rtept", "trkpt"))]
    written = to_gpx(spark.createDataFrame(rows, FOUND))
    for strict in (False, True):
        got = found_points(written, strict).orderBy("gpx_index").collect()
        assert [(r.gpx_index, r.point_type, r.raw_lat, r.raw_time) for r in got] == [(i, k, str(i), 'x<y&"z') for i, k in enumerate(("wpt", "rtept", "rtept", "trkpt"))]
        assert got[0].extensions is None and "<hr>1</hr>" in got[3].extensions.replace("ns0:", "")
    bad = written.unionAll(spark.createDataFrame([("b", "b.gpx", "<gpx><trk>")], written.schema))
    assert [r.file_name for r in malformed_files(bad).collect()] == ["b.gpx"]
    for strict in (False, True):
        assert found_points(bad, strict, skip_malformed=True).count() == 4


def test_exports_and_prevalence(classified):
    d = sampling.time_deltas(classified)
    for r in delta_documents(d).collect():
        doc = json.loads(r.json)
        assert doc["count"] == len(doc["deltas"]) and [x["toIndex"] for x in doc["deltas"]] == sorted(x["toIndex"] for x in doc["deltas"])
    rows = {r.kind: r for r in prevalence(classified).collect()}
    for k in KINDS:
        assert rows[k].points == classified.where(F.col("temporal_class") == k).count()
    joint = sampling.joint_pairs(classified)
    assert joint.where("dt_sec <= 0 or dd_meters <= 0").count() == 0
    assert motion.pairs(classified).where("pair_class = 'forward' and dt_sec <= 0").count() == 0


def test_one_shuffle_serves_all_windows(spark):
    plan = classify(ingest.points(spark.createDataFrame(random_tracks(5), FOUND)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" not in plan
