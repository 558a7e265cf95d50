"""Points from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """ISO text of a timestamp, to the millisecond, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as found points: a track per user, with anomalies at fixed places so that every branch of an audit has rows.

    Points are numbered on track_id itself, so that the exchange serves the audit's windows as well.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("track_id"), "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    w = Window.partitionBy("track_id").orderBy("event_id")
    events = events.withColumns({"index": F.row_number().over(w) - 1, "before": F.lag("ts").over(w), "start": F.first("ts").over(w)})  # once each, however often they are named
    index = F.col("index")
    every = lambda n: F.col("event_id") % n == 0
    lat, lon = F.format_string("%.6f", F.lit(12.97) + F.coalesce("value", F.lit(0.0)) / 10000), F.format_string("%.6f", F.lit(77.59) + F.coalesce("k", F.lit(0.0)) / 10000)
    place = index % 50
    time = F.when(every(23), None).when(every(29), F.concat(F.lit("INVALID_"), "event_id"))
    # Blocks: of one time again and again, and of times long before.
    time = time.when(place.between(20, 23), iso(F.col("start"))).when(place.between(30, 33), iso(F.col("ts") - F.expr("INTERVAL 4000 DAYS")))
    time = time.when(every(31), iso(F.coalesce("before", "ts"))).when(every(37), iso(F.col("ts") - F.expr("INTERVAL 6 HOURS"))).otherwise(iso(F.col("ts")))
    return events.select(
        "track_id", F.concat("track_id", F.lit(".gpx")).alias("file_name"), index.cast("bigint").alias("gpx_index"), F.lit("trkpt").alias("point_type"),
        F.when(every(97), "not-a-lat").when(every(89), "95.5").otherwise(lat).alias("raw_lat"), lon.alias("raw_lon"), F.lit(None).cast("string").alias("raw_ele"), time.alias("raw_time"), F.lit(None).cast("string").alias("extensions"),
    )


EVENT_SQL = """found AS (SELECT CAST(user_id AS VARCHAR) AS track_id, CAST(row_number() OVER w - 1 AS BIGINT) AS gpx_index,
    CASE WHEN event_id % 97 = 0 THEN 'not-a-lat' WHEN event_id % 89 = 0 THEN '95.5' ELSE printf('%.6f', 12.97 + coalesce(value, 0) / 10000) END AS raw_lat,
    printf('%.6f', 77.59 + coalesce(CAST(props ->> '$.k' AS DOUBLE), 0) / 10000) AS raw_lon,
    CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'INVALID_' || event_id
         WHEN (row_number() OVER w - 1) % 50 BETWEEN 20 AND 23 THEN strftime(first_value(ts) OVER w, '%Y-%m-%dT%H:%M:%S.%gZ')
         WHEN (row_number() OVER w - 1) % 50 BETWEEN 30 AND 33 THEN strftime(ts - INTERVAL 4000 DAY, '%Y-%m-%dT%H:%M:%S.%gZ')
         WHEN event_id % 31 = 0 THEN strftime(coalesce(lag(ts) OVER w, ts), '%Y-%m-%dT%H:%M:%S.%gZ') WHEN event_id % 37 = 0 THEN strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ')
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS raw_time
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as found points: a track per customer in order of keys, whose dates go back and forth by themselves."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("track_id"), "o_orderdate", "o_totalprice")
    index = F.row_number().over(Window.partitionBy("track_id").orderBy("o_orderkey")) - 1
    return orders.select(
        "track_id", F.concat("track_id", F.lit(".gpx")).alias("file_name"), index.cast("bigint").alias("gpx_index"), F.lit("trkpt").alias("point_type"),
        F.format_string("%.6f", F.lit(12.0) + F.floor("o_totalprice").cast("double") / 1000000).alias("raw_lat"), F.format_string("%.6f", F.lit(77.0) + (F.col("o_orderkey") % 1000).cast("double") / 1000).alias("raw_lon"),
        F.lit(None).cast("string").alias("raw_ele"), iso(F.col("o_orderdate")).alias("raw_time"), F.lit(None).cast("string").alias("extensions"),
    )


ORDER_SQL = """found AS (SELECT CAST(o_custkey AS VARCHAR) AS track_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS gpx_index,
    printf('%.6f', 12.0 + CAST(floor(o_totalprice) AS DOUBLE) / 1000000) AS raw_lat, printf('%.6f', 77.0 + CAST(o_orderkey % 1000 AS DOUBLE) / 1000) AS raw_lon,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS raw_time FROM orders)"""
