"""Chunked classification gives the rows of the whole-track one."""

import random

import pytest
from pyspark.sql import functions as F

from wayscope.operators import ingest, temporal
from wayscope.operators.classify import classify
from wayscope.operators.segmented import classify_segmented
from wayscope.schemas import FOUND


def tracks(seed, n=40):
    """Tracks whose times stand still, fall back, rise again and are missing, in runs as long as several chunks."""
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        now, index = 50, 0
        for _ in range(rng.randint(1, 12)):
            what = rng.choice(["missing", "junk", "same", "back", "up", "any", "bad", "gap"])
            for _ in range(rng.randint(1, 9)):
                now = {"back": now - rng.randint(0, 2), "up": now + rng.randint(0, 3), "any": rng.randint(0, 99)}.get(what, now)
                time = None if what == "missing" else "junk" if what == "junk" else f"2026-01-01T00:{now % 6000 // 60:02d}:{now % 60:02d}Z"
                lat = "bad" if what == "bad" else f"{rng.uniform(-80, 80):.5f}"
                rows.append((f"t{t}", f"t{t}.gpx", index, "trkpt", lat, f"{rng.uniform(-170, 170):.5f}", None, time, None))
                index += rng.randint(8, 30) if what == "gap" else 1
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 5, 6, 7, 10_000])
def test_same_rows(spark, chunk):
    points = ingest.points(spark.createDataFrame(tracks(chunk), FOUND))
    whole, cut = classify(points), classify_segmented(points, chunk)
    assert whole.columns == cut.columns and whole.schema.simpleString() == cut.schema.simpleString()
    assert rows_of(whole) == rows_of(cut)
    assert rows_of(temporal.blocks(whole)) == rows_of(temporal.blocks(cut)) and rows_of(temporal.isolated(whole)) == rows_of(temporal.isolated(cut))


def test_one_track_is_many_tasks(spark):
    """No task holds more of a track than some chunks."""
    n, chunk = 40_000, 500
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") - F.when(F.col("id") % 1000 >= 990, 2000).otherwise(0)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    points = spark.range(n).select(
        F.lit("t").alias("track_id"), F.col("id").alias("gpx_index"), F.lit("trkpt").alias("point_type"), (F.col("id") % 90).cast("double").alias("lat"), F.lit(0.0).alias("lon"),
        F.lit(None).cast("double").alias("ele"), F.when(F.col("id") % 7 != 3, time).alias("time_raw"), F.lit(None).cast("string").alias("extensions"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = classify_segmented(points, chunk)
        sizes = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) < n
    assert rows_of(temporal.runs(got)) == rows_of(temporal.runs(classify(points)))


def test_no_points(spark):
    assert classify_segmented(ingest.points(spark.createDataFrame([], FOUND))).count() == 0
