"""Expectations held against figures."""

import pytest

from wayscope.plans import held, report, statuses
from wayscope.plans.report import CHECKS


def test_statuses_and_text(spark):
    m = spark.createDataFrame([("a", 5, 0.25, True), ("b", 0, None, False)], "track_id string, points long, share double, several boolean")
    checks = [
        ("a", "points", "points", "eq", 5.0, False), ("a", "share", "share", "atLeast", 0.5, True), ("b", "many", "points", "atLeast", 1.0, None),
        ("b", "share", "share", "eq", 0.0, True), ("c", "lost", "points", "eq", 1.0, False), ("a", "kinds", "several", "eq", 1.0, False), ("b", "no figure", "other", "eq", 1.0, True),
    ]
    c = spark.createDataFrame(checks, CHECKS)
    got = {(r.track_id, r.description): (r.expected, r.actual, r["pass"], r.status) for r in held(m, c).collect()}
    assert got["a", "points"] == ("eq 5", 5.0, True, "PASS") and got["a", "share"] == ("atLeast 0.5", 0.25, False, "EXPECTED_VARIANCE")
    assert got["b", "many"][3] == "FAIL" and got["b", "share"][1:] == (None, False, "EXPECTED_VARIANCE") and got["c", "lost"][3] == "FAIL" and got["a", "kinds"][2]
    assert {r.track_id: (r.status, r.checks, r.failed) for r in statuses(held(m, c)).collect()} == {"a": ("EXPECTED_VARIANCE", 3, 1), "b": ("FAIL", 3, 3), "c": ("FAIL", 1, 1)}
    text = {r.track_id: r.text for r in report(m, c).collect()}
    assert text["a"] == "## a: EXPECTED_VARIANCE\n- PASS: kinds, expected eq 1, found 1\n- PASS: points, expected eq 5, found 5\n- EXPECTED_VARIANCE: share, expected atLeast 0.5, found 0.25\nFigures: points=5, several=1, share=0.25\n"
    assert text["c"].endswith("found null\nFigures: none\n")
    with pytest.raises(Exception, match="no such kind"):
        held(m, spark.createDataFrame([("a", "x", "points", "below", 1.0, False)], CHECKS)).collect()
