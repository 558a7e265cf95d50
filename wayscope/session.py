"""A Spark session with the settings that audits rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "wayscope", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; conf: further settings, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
