"""Expectations of tracks' figures, held against what was counted, and a report of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import js_number

CHECKS = "track_id string, description string, key string, kind string, value double, soft boolean"


def figures(metrics: DataFrame) -> DataFrame:
    """track_id, key and actual of every figure of metrics() or track_metrics(); truth values are 1 and 0."""
    keys = [c for c, kind in metrics.dtypes if c != "track_id" and kind != "string"]
    return metrics.select("track_id", *(F.col(k).cast("double").alias(k) for k in keys)).unpivot("track_id", keys, "key", "actual")


def held(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """checks (track_id, description, key, kind, value, soft) with expected, actual, pass and status.

    kind eq: the figure is value; atLeast: it is value or more. A figure that is null, or isn't there, fails. Failures are FAIL, of soft checks
    EXPECTED_VARIANCE. Other kinds raise.
    """
    met = checks.join(figures(metrics), ["track_id", "key"], "left")
    other = F.raise_error(F.concat(F.lit("no such kind of check: "), F.coalesce("kind", F.lit("null")))).cast("boolean")
    ok = F.when(F.col("kind") == "eq", F.col("actual") == F.col("value")).when(F.col("kind") == "atLeast", F.col("actual") >= F.col("value")).otherwise(other)
    told = met.withColumns({"pass": F.coalesce(ok, F.lit(False)), "expected": F.concat_ws(" ", "kind", js_number(F.col("value")))})
    status = F.when(F.col("pass"), "PASS").when(F.coalesce("soft", F.lit(False)), "EXPECTED_VARIANCE").otherwise("FAIL")
    return told.select("track_id", "description", "key", "expected", "actual", "pass", status.alias("status"))


def statuses(checked: DataFrame) -> DataFrame:
    """track_id, status, checks and failed of each track: FAIL if any check fails, else EXPECTED_VARIANCE if any soft one does, else PASS."""
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("FAIL"), "FAIL").when(has("EXPECTED_VARIANCE"), "EXPECTED_VARIANCE").otherwise("PASS")
    return checked.groupBy("track_id").agg(status.alias("status"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("pass")).alias("failed"))


def report(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """track_id and text, a section of a report for each track with checks: its status, each check in order of description, and all its figures."""
    own = held(metrics, checks)
    number = lambda c: F.coalesce(js_number(F.col(c)), F.lit("null"))
    line = F.concat(F.lit("- "), "status", F.lit(": "), "description", F.lit(", expected "), "expected", F.lit(", found "), number("actual"))
    lines = own.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("description", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    every = figures(metrics).groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), number("actual")))), ", ").alias("all"))
    met = statuses(own).join(lines, "track_id").join(every, "track_id", "left")
    none = F.coalesce("all", F.lit("none"))
    return met.select("track_id", F.concat(F.lit("## "), "track_id", F.lit(": "), "status", F.lit("\n"), "lines", F.lit("\nFigures: "), none, F.lit("\n")).alias("text"))
