"""How common anomalies are over all tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal
from ..schemas import KINDS


def prevalence(classified: DataFrame) -> DataFrame:
    """kind, tracks, tracks_affected, points, share of points; one row per kind of temporal anomaly."""
    s = temporal.summary(classified)
    total = s.agg(F.count(F.lit(1)).alias("tracks"), F.sum("points_evaluated").alias("all_points"), *(F.count_if(F.col(k) > 0).alias(f"{k}_tracks") for k in KINDS), *(F.sum(k).alias(f"{k}_points") for k in KINDS))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("tracks"), F.col(f"{k}_tracks").alias("tracks_affected"), F.col(f"{k}_points").alias("points"), (F.col(f"{k}_points") / F.col("all_points")).alias("share")) for k in KINDS))
    return total.select(F.explode(rows).alias("x")).select("x.*")
