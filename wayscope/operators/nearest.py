"""The point of a track nearest to each probe, without meeting all points.

Each track's box is a grid of cells, and these are the finest of a pyramid in which eight by eight cells make one of the next level. A probe goes
down the pyramid: of the cells it may still need, those open further whose box of points begins no farther than the nearest box ends. So in
the end a probe meets only the points of cells that may hold its nearest one, however far from the track it lies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a finest cell, about, if they were spread evenly; cells of one level along each side of a cell above.
CELL_POINTS, SIDE = 256, 8


def levels_for(most_points: int) -> int:
    """Levels below the whole track that bring its cells down to CELL_POINTS points."""
    return max(0, math.ceil(math.log(max(1, most_points / CELL_POINTS), SIDE * SIDE)))


def _squared(lat: Column, lon: Column) -> Column:
    return lat * lat + lon * lon


def _own(points: DataFrame) -> DataFrame:
    return points.select("track_id", "gpx_index", "lat", "lon").where("lat is not null and lon is not null")


def _box() -> dict[str, Column]:
    return {"lat0": F.min("lat"), "lat1": F.max("lat"), "lon0": F.min("lon"), "lon1": F.max("lon")}


def boxed(points: DataFrame) -> DataFrame:
    """points with the box of their track's points, lat0, lat1, lon0 and lon1, for nearest_point(): found in passing where tracks lie together already."""
    track = Window.partitionBy("track_id")
    return _own(points).withColumns({k: x.over(track) for k, x in _box().items()})


def _gridded(points: DataFrame, levels: int) -> DataFrame:
    """points with cx and cy, their cell of the finest level."""
    own = _own(points)
    if set(_box()) <= set(points.columns):
        told = points
    else:
        told = own.join(own.groupBy("track_id").agg(*(x.alias(k) for k, x in _box().items())), "track_id")
    n = SIDE**levels

    def cell(x: str) -> Column:
        share = (F.col(x) - F.col(f"{x}0")) / F.nullif(F.col(f"{x}1") - F.col(f"{x}0"), F.lit(0.0))
        return F.least(F.lit(n - 1), F.coalesce(F.floor(share * n), F.lit(0))).cast("long")

    return told.select(*own.columns, cell("lat").alias("cy"), cell("lon").alias("cx"))


def _pyramid(gridded: DataFrame, levels: int) -> list[DataFrame]:
    """Occupied cells with the boxes of their points, from the finest level up to the one below the whole track."""
    low, high = ("lat_low", "lon_low"), ("lat_high", "lon_high")
    at = gridded.groupBy("track_id", "cy", "cx").agg(F.min("lat").alias("lat_low"), F.max("lat").alias("lat_high"), F.min("lon").alias("lon_low"), F.max("lon").alias("lon_high"))
    out = [at]
    for _ in range(levels - 1):
        above = out[-1].withColumns({"cy": F.shiftright("cy", 3), "cx": F.shiftright("cx", 3)})
        out.append(above.groupBy("track_id", "cy", "cx").agg(*(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high)))
    return out


def nearest_point(points: DataFrame, probes: DataFrame, levels: int | None = None) -> DataFrame:
    """probe_id, track_id, gpx_index, lat, lon of each track's point nearest to each probe (probe_id, track_id, lat, lon) of that track.

    Nearest in squared degrees, the first of equally near ones; probes of tracks without points, and those without a position, have no row. levels:
    of the pyramid; by default as many as the track of most points needs, which a count of the points tells. 0 compares all points of a track. Boxes
    of tracks are found by a pass over the points of their own, unless the points are boxed().
    """
    if levels is None:
        levels = levels_for(points.groupBy("track_id").count().agg(F.max("count")).first()[0] or 0)
    gridded = _gridded(points, levels)
    p_lat, p_lon = F.col("p_lat"), F.col("p_lon")
    asked = probes.select("probe_id", "track_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).where("p_lat is not null and p_lon is not null")
    front = asked.withColumns({"py": F.lit(0).cast("long"), "px": F.lit(0).cast("long")})
    each_probe = Window.partitionBy("probe_id", "track_id")
    for cells in reversed(_pyramid(gridded, levels)) if levels else ():
        below = cells.withColumns({"py": F.shiftright("cy", 3), "px": F.shiftright("cx", 3)})
        met = front.join(below, ["track_id", "py", "px"])
        # From the probe to the nearest and the farthest place of each box; rounding keeps the order of both with points inside.
        near = _squared(F.greatest(F.col("lat_low") - p_lat, p_lat - F.col("lat_high"), F.lit(0.0)), F.greatest(F.col("lon_low") - p_lon, p_lon - F.col("lon_high"), F.lit(0.0)))
        far = _squared(F.greatest(F.col("lat_high") - p_lat, p_lat - F.col("lat_low")), F.greatest(F.col("lon_high") - p_lon, p_lon - F.col("lon_low")))
        bounded = met.select("probe_id", "track_id", "p_lat", "p_lon", "cy", "cx", near.alias("near"), F.min(far).over(each_probe).alias("bound"))
        front = bounded.where("near <= bound").select("probe_id", "track_id", "p_lat", "p_lon", F.col("cy").alias("py"), F.col("cx").alias("px"))
    on = gridded.withColumnsRenamed({"cy": "py", "cx": "px"})
    d = _squared(F.col("lat") - p_lat, F.col("lon") - p_lon)
    best = front.join(on, ["track_id", "py", "px"]).groupBy("probe_id", "track_id").agg(F.min(F.struct(d.alias("d"), "gpx_index", "lat", "lon")).alias("x"))
    return best.select("probe_id", "track_id", "x.gpx_index", "x.lat", "x.lon")

