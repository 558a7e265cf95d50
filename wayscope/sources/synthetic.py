"""Generated tracks, for tests and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import POINT_TYPES


def linear_track(spark: SparkSession, track_id: str, count: int, start: tuple[float, float], step: tuple[float, float], base_ms: int, dt_sec: float) -> DataFrame:
    """Found points on a straight line at an even pace, coordinates to six decimals."""
    at = F.timestamp_millis(F.lit(base_ms) + (F.col("id") * F.lit(dt_sec * 1000)).cast("bigint"))
    place = lambda i: fixed(F.lit(float(start[i])) + F.col("id") * F.lit(float(step[i])), 6)
    return spark.range(count).select(
        F.lit(track_id).alias("track_id"), F.lit(f"{track_id}.gpx").alias("file_name"), F.col("id").alias("gpx_index"), F.lit("trkpt").alias("point_type"), place(0).alias("raw_lat"), place(1).alias("raw_lon"),
        F.lit("100").alias("raw_ele"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("raw_time"), F.lit(None).cast("string").alias("extensions"),
    )


def _escaped(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def to_gpx(found: DataFrame) -> DataFrame:
    """track_id, file_name, xml: found points written as one GPX document per track: waypoints, then a route, then a track of one segment, each
    in stream order. Values are escaped, except extensions, which hold XML."""
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    given = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(c), F.lit('"')), F.lit(""))
    inside = F.concat(tag("ele", _escaped("raw_ele")), tag("time", _escaped("raw_time")), tag("extensions", F.col("extensions")))
    point = F.concat(F.lit("<"), "point_type", given("lat", "raw_lat"), given("lon", "raw_lon"), F.lit(">"), inside, F.lit("</"), "point_type", F.lit(">"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("point_type") == kind, F.struct("gpx_index", point.alias("xml"))))).alias(kind)
    body = found.groupBy("track_id", "file_name").agg(*map(listed, POINT_TYPES))
    part = lambda kind, head, foot: F.when(F.size(kind) > 0, F.concat(F.lit(head), F.array_join(F.transform(kind, lambda x: x["xml"]), "\n"), F.lit(foot + "\n"))).otherwise("")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="wayscope" xmlns="http://www.topografix.com/GPX/1/1">\n'
    parts = part("wpt", "", ""), part("rtept", "<rte>\n", "\n</rte>"), part("trkpt", "<trk><trkseg>\n", "\n</trkseg></trk>")
    return body.select("track_id", "file_name", F.concat(F.lit(head), *parts, F.lit("</gpx>\n")).alias("xml"))
