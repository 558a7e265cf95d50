"""Coordinates are validated, never repaired; rejected points keep their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js_number, parse_float, trimmed
from ..schemas import POINT_TYPES


def _parsed(found: DataFrame) -> DataFrame:
    """found with lat, lon, ele and time_raw. Coordinates are generated, a row for each row, as filters on them stay above a generator: below
    it they would read the texts a second time."""
    both = F.struct(parse_float(F.col("raw_lat")).alias("lat"), parse_float(F.col("raw_lon")).alias("lon"))
    return found.select("*", F.inline(F.array(both))).withColumns({"ele": parse_float(F.col("raw_ele")), "time_raw": F.nullif(trimmed(F.col("raw_time")), F.lit(""))})


def _inside() -> Column:
    """Whether both coordinates are numbers in range; NaN ranks above every number."""
    return F.coalesce((F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False))


def _reason() -> Column:
    """Why a point that isn't inside is rejected."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("null")), F.lit('"'))
    number = F.concat(F.lit("Invalid coordinates: lat="), quoted("raw_lat"), F.lit(", lon="), quoted("raw_lon"), F.lit(" (not parseable as numbers)"))
    reach = F.concat(F.lit("Coordinates out of valid range or non-finite: lat="), js_number(F.col("lat")), F.lit(" (must be -90 to 90), lon="), js_number(F.col("lon")), F.lit(" (must be -180 to 180)"))
    return F.when(F.col("lat").isNull() | F.col("lon").isNull(), number).otherwise(reach)


def checked(found: DataFrame) -> DataFrame:
    """found with lat, lon, ele, time_raw and reason (null for valid points)."""
    return _parsed(found).withColumn("reason", F.when(~_inside(), _reason()))


def points(found: DataFrame) -> DataFrame:
    return _parsed(found).where(_inside()).select("track_id", "gpx_index", "point_type", "lat", "lon", "ele", "time_raw", "extensions")


def rejected(found: DataFrame) -> DataFrame:
    return _parsed(found).where(~_inside()).select("track_id", "gpx_index", "point_type", "raw_lat", "raw_lon", "raw_ele", "raw_time", _reason().alias("reason"))


def counts(found: DataFrame) -> DataFrame:
    """Per track: points found, valid and rejected, found per type, and what the audit says about the whole."""
    kinds = [F.count_if(F.col("point_type") == k).alias(k) for k in POINT_TYPES]
    valid = F.col("valid")
    own = _parsed(found).withColumn("valid", _inside()).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if(valid).alias("valid_points"), F.count_if(~valid).alias("rejected_points"), *kinds,
        F.coalesce(F.bool_or(valid & F.col("time_raw").isNotNull()), F.lit(False)).alias("has_any_timestamp_values"),
    )
    several = sum((F.col(k) > 0).cast("int") for k in POINT_TYPES) > 1
    return own.withColumn("has_multiple_point_types", several)
