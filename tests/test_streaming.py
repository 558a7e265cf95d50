"""The audit of a stream, over restarts, equals the batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wayscope.operators import ingest, motion, temporal
from wayscope.operators.classify import classify
from wayscope.schemas import FOUND
from wayscope.streaming import audit_stream, found_blocks, found_counts, found_isolated, found_pairs, stream_settings

from .test_segmented import tracks

POINT = "track_id string, gpx_index long, time_raw string, lat double, lon double"


@pytest.fixture(autouse=True)
def settings(spark):
    for k, v in stream_settings().items():
        spark.conf.set(k, v)
    yield
    for k in stream_settings():
        spark.conf.unset(k)


def keyed(df):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.collect())


def write(spark, table, path):
    spark.createDataFrame(table, POINT).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, **options):
    """Take in all files not seen yet, from the checkpoint of the run before."""
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    query = audit_stream(stream, **options).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert query.exception() is None


@pytest.fixture(scope="module")
def points(spark):
    found = ingest.points(spark.createDataFrame(tracks(11, 14), FOUND)).select("track_id", "gpx_index", "time_raw", "lat", "lon")
    return [tuple(r) for r in found.orderBy("gpx_index", "track_id").collect()]


def same(spark, tmp, points):
    c = classify(spark.createDataFrame(points, POINT)).cache()
    found = spark.read.parquet(f"{tmp}/out").cache()
    assert keyed(found_blocks(found)) == keyed(temporal.blocks(c)) and found_blocks(found).count() > 5
    assert keyed(found_isolated(found)) == keyed(temporal.isolated(c))
    assert keyed(found_pairs(found)) == keyed(motion.pairs(c).select(*found_pairs(found).columns))
    counts = c.groupBy("track_id", F.col("temporal_class").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    assert keyed(found_counts(found)) == keyed(counts)


def test_over_restarts(spark, points, tmp_path):
    """Half the points, a restart, the other half in two batches, a restart, and the ends of all tracks."""
    third = len(points) // 3
    write(spark, points[:third], f"{tmp_path}/in")
    run(spark, tmp_path)
    write(spark, points[third : 2 * third], f"{tmp_path}/in")
    write(spark, points[2 * third :], f"{tmp_path}/in")
    run(spark, tmp_path)
    write(spark, [(t, None, None, None, None) for t in sorted({p[0] for p in points})], f"{tmp_path}/in")
    run(spark, tmp_path)
    same(spark, tmp_path, points)


def test_held_back(spark, points, tmp_path):
    """Neighbours that come in the wrong order over batches are put right where points are held back; all of it ends in one batch."""
    rng = random.Random(3)
    mixed = sorted(points, key=lambda p: (p[1] + rng.choice([0, 0, 1.5]), p[0]))
    half = len(mixed) // 2
    write(spark, mixed[:half], f"{tmp_path}/in")
    run(spark, tmp_path, held=4)
    write(spark, [*mixed[half:], *((t, None, None, None, None) for t in sorted({p[0] for p in points}))], f"{tmp_path}/in")
    run(spark, tmp_path, held=4)
    same(spark, tmp_path, points)


def test_idle_tracks_are_over(spark, tmp_path):
    write(spark, [("a", 0, None, 1.0, 1.0), ("a", 1, None, 1.0, 1.0)], f"{tmp_path}/in")
    stream = spark.readStream.schema(POINT).parquet(f"{tmp_path}/in")
    query = audit_stream(stream, idle_ms=500).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("idle").count() < 2:
            time.sleep(0.5)
        got = {(r.finding, r.kind, r.length) for r in spark.table("idle").collect()}
    finally:
        query.stop()
    assert got == {("run", "missing", 2), ("count", "missing", 2)}
