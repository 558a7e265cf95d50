"""Exact medians of groups of any size, by rounds of histograms.

Each round counts a group's values by bucket: by sign and power of two first, then by equal parts of what is left, so that a round settles
sixteen leading bits. The bucket of the middle value is then known, and only the values between its ends take part in the next round. What a task
holds of a group is a histogram, which combines before the shuffle, and never the values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, ROUNDS = 1 << 16, 5  # sign and power, then the 52 bits of a double's fraction
FEW = 4096


def _power(x: Column) -> Column:
    """Whole numbers in the order of doubles by sign and power of two; neighbours may share one."""
    size = F.floor(F.log2(F.abs(x))).cast("long") + 2000
    own = F.when(x > 0, size).when(x < 0, -size).otherwise(0)
    return F.when(F.isnan(x), 20_000).when(F.abs(x) == F.lit(math.inf), F.signum(x).cast("long") * 10_000).otherwise(own)


def _part(x: Column) -> Column:
    """Which of BUCKETS equal parts between lo and hi."""
    return F.when(F.col("hi") > F.col("lo"), F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BUCKETS - 1))).otherwise(0).cast("long")


def exact_medians(values: DataFrame, by: list[str], column: str, rounds: int | None = None) -> DataFrame:
    """by, n and median of each group's values; nulls don't count, and NaN ranks above every number. Of an even number of values, the mean of both
    middle ones.

    rounds: as many as the largest group needs by default, which a count tells: none up to FEW values, else ROUNDS, after which every bucket that
    is left holds one value. What is left after the rounds is sorted by distinct values.
    """
    x = F.col("x_")
    own = values.select(*by, F.col(column).cast("double").alias("x_")).where("x_ is not null")
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if rounds is None:
        rounds = ROUNDS if (sizes.agg(F.max("n")).first()[0] or 0) > FEW else 0
    half = F.floor(F.col("n") / 2)
    wanted = F.posexplode(F.when(F.col("n") % 2 == 1, F.array(half)).otherwise(F.array(half - 1, half))).alias("t", "k")
    below, mine = (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c")), (F.col("k") - F.col("before")).alias("k")
    tally = [F.count(F.lit(1)).alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi")]
    upto = lambda *keys: F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if rounds:
        # The first histogram holds all values, and so tells a group's size too.
        first = own.groupBy(*by, _power(x).alias("bucket")).agg(*tally).withColumns({"n": F.sum("c").over(Window.partitionBy(*by)), "before": upto(*by)})
        targets = first.select("*", wanted).where(below).select(*by, "n", "t", mine, "lo", "hi")
    else:
        targets = sizes.select(*by, "n", wanted).withColumns({"lo": F.lit(-math.inf), "hi": F.lit(math.nan)})
    for r in range(min(1, rounds), rounds + 1):
        met = own.join(targets, by).where((x >= F.col("lo")) & (x <= F.col("hi")))
        bucket = x if r == rounds else _part(x)
        counted = met.groupBy(*by, "t", "k", "n", bucket.alias("bucket")).agg(*tally).withColumn("before", upto(*by, "t"))
        targets = counted.where(below).select(*by, "n", "t", mine, "lo", "hi")
    return targets.groupBy(*by).agg(F.first("n").alias("n"), F.avg("lo").alias("median"))
