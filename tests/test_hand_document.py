"""One track's whole document, worked out by hand: every section, both ways to read GPX, exports and metrics."""

import json
import math

import pytest
from pyspark.sql import functions as F

from wayscope.operators import ingest, sampling
from wayscope.operators.classify import classify
from wayscope.plans import audit_documents, delta_documents, metrics, to_json_rows, track_metrics
from wayscope.sources import found_points, read_gpx

from .test_golden import differences

#: kind, thousandths of a degree north on the zero meridian (or text), time of day. The fifth is rejected and keeps its index.
TRACK = [
    ("wpt", 0, "00:00:00Z"), ("rtept", 1, None), ("rtept", 1, "nope"), ("trkpt", 2, "00:00:10Z"), ("trkpt", "91", "00:00:20Z"), ("trkpt", 4, "00:00:10Z"), ("trkpt", 4, "00:00:10Z"), ("trkpt", 5, "00:00:30Z"),
    ("trkpt", 6, "00:00:25Z"), ("trkpt", 7, "00:00:45.300Z"),
]
D = 6371000 * math.pi / 180 / 1000  # metres in a thousandth of a degree


def gpx():
    def tags(kind):
        at = lambda n: n if isinstance(n, str) else f"{n / 1000}"
        when = lambda t: "" if t is None else f"<time>{t if t == 'nope' else '2026-01-01T' + t}</time>"
        return "".join(f'<{k} lat="{at(n)}" lon="0">{when(t)}</{k}>' for k, n, t in TRACK if k == kind)

    return f'<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">{tags("wpt")}<rte>{tags("rtept")}</rte><trk><trkseg>{tags("trkpt")}</trkseg></trk></gpx>'


def order(points, ratio, longest, blocks, events, depth=None):
    second = {"maxDepthFromAnchorMs": depth} if depth else {"pointCountOverTotalPointsRatio": ratio}
    return {"pointCount": points} | second | {"maxBlockLength": longest, "blocks": blocks, "isolatedPointCount": len(events), "isolatedPointEvents": events}


def cluster(centre, count, low, high, joined_rel, joined_abs, off):
    n = (joined_rel / count, joined_rel, joined_abs / count, joined_abs, off, off, off / centre, off / centre)
    names = ("meanInsertionRelativeDeviation", "maxInsertionRelativeDeviation", "meanInsertionAbsoluteDeviationSec", "maxInsertionAbsoluteDeviationSec", "finalMeanAbsoluteDeviationSec", "finalMaxAbsoluteDeviationSec", "finalMeanRelativeDeviation", "finalMaxRelativeDeviation")
    head = {"centerSec": centre, "count": count, "clusterShareOfTotalDeltas": count / 3, "minSec": low, "maxSec": high, "spreadSec": high - low}
    return head | dict(zip(names, n, strict=True)) | {"finalSpreadOverCenterRatio": (high - low) / centre}


def document():
    """Deltas are 10, 20 and 20.3 s: 20.3 lies 1.5 % off 20 and joins it, about a centre of 20.15 then."""
    reason = "Coordinates out of valid range or non-finite: lat=91 (must be -90 to 90), lon=0 (must be -180 to 180)"
    out = {"gpxIndex": 4, "pointType": "trkpt", "rawLat": "91", "rawLon": "0", "rawEle": None, "rawTime": "2026-01-01T00:00:20Z", "reason": reason}
    ingestion = {
        "counts": {"totalPointCount": 10, "validPointCount": 9, "rejectedPointCount": 1, "pointTypeCounts": {"wpt": 1, "rtept": 2, "trkpt": 7}},
        "context": {"hasMultiplePointTypes": True, "hasAnyTimestampValues": True}, "rejections": {"events": [out]},
    }
    temporal = {
        "totalPointsEvaluated": 9, "session": {"rawSessionDurationSec": 45.3, "parseableTimestampPointCount": 7},
        "temporalOrder": {
            "monotonicForwardCount": 3, "missing": order(1, 1 / 9, 0, [], [{"index": 1}]), "unparsable": order(1, 1 / 9, 0, [], [{"index": 2, "rawTime": "nope"}]),
            "duplicate": order(2, 2 / 9, 2, [{"startIndex": 5, "endIndex": 6, "length": 2, "time": "00:00:10"}], []),
            "backtracking": order(1, None, 0, [], [{"index": 8, "prevIndex": 7, "prevTime": "00:00:30", "currTime": "00:00:25"}], 5000),
        },
    }
    pairs = [{"fromIndex": a, "toIndex": b, "delta": d} for a, b, d in ((3, 5, 0), (5, 6, 0), (7, 8, -5000))]
    ratios = {"sortedClusterCountOverTotalDeltasRatio": 2 / 3, "sequentialClusterCountOverTotalDeltasRatio": 2 / 3, "sequentialOverSortedClusterCountRatio": 1}
    found = {"insertionRelativeThreshold": 0.02, "sortedClusterCount": 2, "sequentialClusterCount": 2}
    far = {"meanFinalAbsoluteDeviationSec": 0.1, "maxFinalAbsoluteDeviationSec": 0.15, "meanFinalRelativeDeviation": 0.1 / 20.15, "maxFinalRelativeDeviation": 0.15 / 20.15}
    time = {
        "timestampContext": {
            "hasAnyParseableTimestamp": True, "hasAnyPositiveTimeDelta": True, "timestampedPointsCount": 7, "consecutiveTimestampPairsCount": 6, "positiveTimeDeltaCount": 3,
            "rejections": {"nonPositiveTimeDeltaPairs": {"nonPositivePairCount": 3, "events": pairs}},
        },
        "deltaStatistics": {"positiveDeltaCount": 3, "minMs": 10000, "maxMs": 20300, "medianMs": 20000},
        "clustering": found | ratios | {"clusters": [cluster(20.15, 2, 20, 20.3, 0.015, 0.3, 0.15), cluster(10, 1, 10, 10, 0, 0, 0)]},
        "normalization": found | far | ratios | {"nonZeroFinalDeviationCount": 2, "zeroFinalDeviationCount": 1},
    }
    distance = {"pairInspection": {"consecutivePairCount": 8, "rejections": {"invalidDistance": {"count": 0}}}, "geometryConditioned": {"deltaCount": 8}, "timeConditioned": {"deltaCount": 3}}
    raw = lambda a, b, t, m: {"fromIndex": a, "toIndex": b, "rawTime": t, "ddMeters": m}
    timed = lambda a, b, s, m: {"fromIndex": a, "toIndex": b, "dtSec": s, "ddMeters": m}
    motion = {
        "evaluatedPairs": {"consecutivePairCount": 8, "forwardValidPairCount": 3},
        "rejections": {
            "missingTimestampPairCount": 1, "unparsableTimestampPairCount": 1, "nonFiniteDistancePairCount": 0, "backwardTimePairCount": 1, "zeroTimeDeltaPairCount": 2,
            "events": {
                "missingTimestamp": [raw(0, 1, None, D)], "unparsableTimestamp": [raw(0, 2, "nope", D)], "nonFiniteDistance": [], "backward": [timed(7, 8, -5, D)],
                "zeroTimeDelta": [timed(3, 5, 0, 2 * D), timed(5, 6, 0, 0)],
            },
        },
        "time": {"validMotionTimeSeconds": 50.3, "invalidTimeSeconds": 5, "invalidTimeShareOfEvaluatedTime": 5 / 55.3},
        "distance": {"totalForwardValidDistanceMeters": 4 * D}, "speed": {"meanSpeedMps": 4 * D / 50.3, "medianSpeedMps": D / 20, "maxSpeedMps": D / 5},
    }
    metadata = {"schemaVersion": "2.0.0", "generatedAtUtc": None, "source": {"fileName": "hand.gpx"}, "summary": {"totalPointCount": 10}}
    return {"metadata": metadata, "audit": {"ingestion": ingestion, "temporal": temporal, "sampling": {"time": time, "distance": distance}, "motion": motion}}


@pytest.mark.parametrize("descendants", [False, True])
def test_document_exports_and_metrics(spark, tmp_path, descendants):
    (tmp_path / "hand.gpx").write_text(gpx())
    found = found_points(read_gpx(spark, f"{tmp_path}/*.gpx"), descendants)
    documents = audit_documents(found)
    (row,) = to_json_rows(documents).collect()
    assert row.track_id == "hand" and differences(json.loads(row.json), document()) == []
    (deltas,) = delta_documents(sampling.time_deltas(classify(ingest.points(found)))).collect()
    assert json.loads(deltas.json) == {"deltas": [{"fromIndex": a, "toIndex": b, "dtSec": s} for a, b, s in ((0, 3, 10), (6, 7, 20), (8, 9, 20.3))], "count": 3}
    (told,), (own,) = metrics(documents).collect(), track_metrics(found).collect()
    assert told.asDict() == pytest.approx(own.asDict()) and own.duplicate_longest == 2 and own.sorted_clusters == 2


def test_metrics_without_documents_are_those_of_documents(spark):
    """Tracks of many kinds, one without valid points, one without times."""
    rows = [(f"t{i % 7}", i, "bad" if i % 7 == 5 or i % 11 == 0 else f"{i / 100}", None if i % 7 == 6 or i % 5 == 0 else "x" if i % 13 == 0 else f"2026-01-01T00:00:{i * 7 % 60:02d}Z") for i in range(300)]
    t = spark.createDataFrame(rows, "track_id string, gpx_index bigint, raw_lat string, raw_time string")
    found = t.select("track_id", F.concat("track_id", F.lit(".gpx")).alias("file_name"), "gpx_index", F.when(F.col("gpx_index") % 9 == 0, "wpt").otherwise("trkpt").alias("point_type"), "raw_lat", F.lit("7").alias("raw_lon"), F.lit(None).cast("string").alias("raw_ele"), "raw_time", F.lit(None).cast("string").alias("extensions"))
    by = lambda df: {r.track_id: r.asDict() for r in df.collect()}
    a, b = by(metrics(audit_documents(found))), by(track_metrics(found))
    assert set(a) == set(b) == {f"t{i}" for i in range(7)}
    for k in a:
        assert list(a[k]) == list(b[k]) and a[k] == pytest.approx(b[k]), k
