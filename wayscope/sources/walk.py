"""A seeded random walk with sporadic anomalies, whose points are drawn by as many tasks as one likes.

The generator is linear congruential, so its n-th state is one multiplication and addition of the seed, of which the factors follow from n by
squaring: a task jumps to its own draws. Sums and repeated times run over blocks of points first, then over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, js_number

# The generator's factor and increment, modulo 2**32.
FACTOR, INCREMENT, MASK = 1664525, 1013904223, 0xFFFFFFFF
BLOCK = 1 << 14


def states(n: np.ndarray, seed: int) -> np.ndarray:
    """The n-th state after seed, for whole numbers n of any size; state 0 is the seed."""
    n = np.asarray(n, np.uint64)
    a, c = np.ones(len(n), np.uint64), np.zeros(len(n), np.uint64)  # what has been put together so far: x to a x + c
    factor, increment, mask = FACTOR, INCREMENT, np.uint64(MASK)
    while n.any():
        odd = (n & np.uint64(1)).astype(bool)
        a[odd] = a[odd] * np.uint64(factor) & mask
        c[odd] = c[odd] * np.uint64(factor) + np.uint64(increment) & mask
        factor, increment = factor * factor & MASK, (factor * increment + increment) & MASK
        n = n >> np.uint64(1)
    return a * np.uint64(seed & MASK) + c & mask


def _draws(seed: int, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(each)
            drawn = [states(at + np.uint64(k + 1), seed) / 2.0**32 for k in range(each)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, drawn)], ["id", *(f"r{k}" for k in range(each))])

    return run


def seeded_walk(spark: SparkSession, track_id: str, count: int, seed: int, start: tuple[float, float], base_ms: int, partitions: int | None = None, step: float = 0.0002, block: int = BLOCK) -> DataFrame:
    """Found points of a walk: each goes on by up to half a step either way and one to three seconds; of a hundred about two have no time, two a time that
    can't be read, and two the time text of the point before. The same for any number of partitions."""
    ids = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    drawn = ids.mapInArrow(_draws(seed, 4), "id long, r0 double, r1 double, r2 double, r3 double").withColumn("block", F.floor(F.col("id") / F.lit(block)))
    move = lambda r: (F.col(r) - 0.5) * step
    same = (F.col("r3") >= 0.04) & (F.col("r3") < 0.06) & (F.col("id") > 0)
    steps = drawn.select("id", "block", move("r0").alias("d_lat"), move("r1").alias("d_lon"), (F.lit(1) + F.floor(F.col("r2") * 3)).alias("d_sec"), "r3", same.alias("same"))
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumns({f"s{c}": F.sum(f"d{c}").over(inside) for c in ("_lat", "_lon", "_sec")})
    # A row per block: what it adds, and the last point whose time isn't the one before it.
    ends = summed.groupBy("block").agg(*(F.max_by(f"s{c}", "id").alias(f"e{c}") for c in ("_lat", "_lon", "_sec")), F.max_by(F.struct("id", "s_sec", "r3"), F.when(~F.col("same"), F.col("id"))).alias("own"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"b{c}": F.coalesce(F.sum(f"e{c}").over(ahead), F.lit(0)) for c in ("_lat", "_lon", "_sec")}
    told = ends.withColumns(before).withColumn("own", F.struct("own.id", (F.col("own.s_sec") + F.col("b_sec")).alias("sec"), "own.r3"))
    told = told.withColumn("carried", F.last(F.when(F.col("own.id").isNotNull(), F.col("own")), ignorenulls=True).over(ahead)).select("block", *before, "carried")
    met = summed.join(told, "block")
    here = F.struct("id", (F.col("s_sec") + F.col("b_sec")).alias("sec"), "r3")
    said = F.coalesce(F.last(F.when(~F.col("same"), here), ignorenulls=True).over(inside), F.col("carried"))
    point = met.select("id", (F.lit(start[0]) + (F.col("b_lat") + F.col("s_lat"))).alias("lat"), (F.lit(start[1]) + (F.col("b_lon") + F.col("s_lon"))).alias("lon"), said.alias("t"))
    clear = F.date_format(F.timestamp_millis(F.lit(base_ms) + F.col("t.sec") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    time = F.when(F.col("t.r3") < 0.02, F.lit(None)).when(F.col("t.r3") < 0.04, F.concat(F.lit("INVALID_RAND_"), F.col("t.id"))).otherwise(clear)
    coordinate = lambda c: js_number(fixed(F.col(c), 6).cast("double"))
    return point.select(
        F.lit(track_id).alias("track_id"), F.lit(f"{track_id}.gpx").alias("file_name"), F.col("id").alias("gpx_index"), F.lit("trkpt").alias("point_type"), coordinate("lat").alias("raw_lat"), coordinate("lon").alias("raw_lon"),
        F.lit(None).cast("string").alias("raw_ele"), time.alias("raw_time"), F.lit(None).cast("string").alias("extensions"),
    )
