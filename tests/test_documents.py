"""Texts of numbers, and what a document says without some of its sections."""

import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from wayscope.functions import fixed
from wayscope.operators import drill
from wayscope.operators.density import tick
from wayscope.plans import audit_documents, to_json_rows
from wayscope.schemas import FOUND

from .test_segmented import tracks


def exact(x, digits):
    return ("-" if x < 0 else "") + str(Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@pytest.mark.parametrize("digits", [0, 2, 6])
def test_rounding_by_the_exact_value(spark, digits):
    told = {0.145: "0.14", 1.005: "1.00", 0.575: "0.57", 0.125: "0.13", -1.005: "-1.00", -0.001: "-0.00", 8.345: "8.35", 1e8 + 0.005: None, 0.0: "0.00", 0.995: "0.99", 2.5: "2.50"}
    values = [*told, *(k / 1000 + 0.0005 for k in range(-999, 1000, 7)), *(k / 7 for k in range(300)), *(k * 1e6 + 0.5 for k in range(50)), 123456.7890125, 0.0000005, 1.0000005, 1e-20]
    got = {r.x: r.t for r in spark.createDataFrame([(x,) for x in values], "x double").select("x", fixed(F.col("x"), digits).alias("t")).collect()}
    assert {x: exact(x, digits) for x in values} == got
    if digits == 2:
        assert all(got[x] == t for x, t in told.items() if t)
    odd = [r.t for r in spark.createDataFrame([(float("nan"),), (None,), (1e300,)], "x double").select(fixed(F.col("x"), digits).alias("t")).collect()]
    assert odd == ["NaN", None, "1e+300"]


def test_texts_use_it(spark):
    block = spark.createDataFrame([("a", 0.145, 1.005, 2, 0.575)], "track_id string, cumulative_m double, displacement_m double, points long, elapsed_sec double")
    assert drill.block_text(block).first().text.split("\n") == ["cumulativeDistanceM: 0.14", "netDisplacementM: 1.00", "pointCount: 2", "elapsedTimeSec: 0.57"]
    ticks = spark.createDataFrame([(0.145,), (0.575,), (1.5,), (0.0,)], "x double").select(tick(F.col("x"), True).alias("t")).collect()
    assert [r.t for r in ticks] == ["~0.14", "~0.57", "~2", "0"]


@pytest.mark.parametrize("sections", [(), ("ingestion",), ("temporal", "motion"), ("sampling",)])
def test_sections_left_out_are_null(spark, sections):
    found = spark.createDataFrame(tracks(2, 4), FOUND)
    whole = {r.track_id: json.loads(r.json) for r in to_json_rows(audit_documents(found)).collect()}
    counts = spark.createDataFrame([("t0", 77), ("t1", None), ("other", 5)], "track_id string, total_points long")
    some = {r.track_id: json.loads(r.json) for r in to_json_rows(audit_documents(found, sections=sections, point_counts=counts)).collect()}
    assert some.keys() == whole.keys()
    for t, d in some.items():
        assert d["audit"] == {k: v if k in sections else None for k, v in whole[t]["audit"].items()}
        counted = whole[t]["metadata"]["summary"]["totalPointCount"] if "ingestion" in sections else 0
        assert d["metadata"]["summary"]["totalPointCount"] == (77 if t == "t0" else counted)
    with pytest.raises(ValueError, match="no such section"):
        audit_documents(found, sections=("times",))
