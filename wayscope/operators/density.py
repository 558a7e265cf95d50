"""Log-space densities of deltas and the numbers behind charts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, fixed

GRID = 200
FLOOR = 1e-10


def safe_log(x: Column) -> Column:
    return F.ln(F.greatest(F.lit(FLOOR), x))


def _logs(values: DataFrame, column: str) -> DataFrame:
    """Logs of positive values; the log of what isn't positive is null."""
    return values.select("track_id", F.ln(column).alias("x")).where(finite(F.col("x")))


def silverman(deviation: Column, n: Column) -> Column:
    """1.06 deviations by the fifth root of n; a deviation that is 0 or undefined counts as 1."""
    return F.lit(1.06) * F.coalesce(F.nullif(deviation, F.lit(0.0)), F.lit(1.0)) * F.pow(n, F.lit(-0.2))


def bandwidth(values: DataFrame, column: str) -> DataFrame:
    """Silverman's bandwidth of the logs of each track's positive values; a deviation that is 0 or undefined counts as 1."""
    g = _logs(values, column).groupBy("track_id").agg(F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.select("track_id", silverman(F.col("sd"), F.col("n")).alias("h"), "n")


def chosen_bandwidth(option: float | None) -> float | None:
    """The bandwidth of logs that a user's option, given in the unit of the values, stands for: its log. None, that is Silverman's, for none or 0."""
    return math.log(option) if option else None


def kde(values: DataFrame, column: str, h: float | None = None, grid: int = GRID, option: float | None = None) -> DataFrame:
    """track_id, grid_i, x_log, x_linear, y: Gaussian density of the logs at grid points from least to largest.

    h: the bandwidth of the logs; by default what option stands for, else Silverman's. Options below 1 make it negative, and the density with
    it; at 0 (option 1) y is NaN.
    """
    points = kernels(values, column, h, grid, option).select("track_id", "lo", "hi", "n", "h", F.posexplode("sums").alias("grid_i", "sum"))
    return points.select("track_id", "grid_i", *_at(F.col("grid_i"), F.col("sum"), grid))


def kernels(values: DataFrame, column: str, h: float | None = None, grid: int = GRID, option: float | None = None) -> DataFrame:
    """What kde() is made of, a row per track: track_id, lo, hi, n, h, sums, the array of kernel sums over the grid, and tops, the
    grid points whose y lies above both neighbours'.

    Equal values are counted first. A track's distinct values follow each other in one task, as the windows over it left them, and their kernels are summed
    batch by batch into one array; no grid point is a row before the sums are whole, and values are read once.
    """
    counted = _logs(values, column).groupBy("track_id", "x").agg(F.count(F.lit(1)).alias("c"))
    return _spread(counted, ["track_id"], chosen_bandwidth(option) if h is None else h).withColumn("kind", F.lit(0)).mapInArrow(_kernel_sums(grid), _SUMS)


def kernels_by_kind(series: DataFrame) -> DataFrame:
    """track_id, time and distance: what kernels() says of both kinds of sampling.series(), null where a track has no positive values of a kind. One
    stream of values serves both."""
    keys = ["track_id", "kind"]
    counted = series.select(*keys, F.ln("value").alias("x")).where(finite(F.col("x"))).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    return _spread(counted, keys, None).mapInArrow(_kernel_sums(GRID, KINDS), f"track_id string, {', '.join(f'{k} struct<{_FIGURES}>' for k in KINDS)}")


def _spread(counted: DataFrame, keys: list[str], h: float | None) -> DataFrame:
    """Distinct logs x with their counts c, each with its group's lo, hi, n and h, group by group."""
    every = Window.partitionBy(*keys)
    span = {"lo": F.min("x").over(every), "hi": F.max("x").over(every), "n": F.sum("c").over(every)}
    if h is None:
        # Squares of what lies above the least value, so that little is lost where values differ little.
        off = F.col("x") - F.col("lo")
        wide = counted.withColumns(span).withColumns({"s": F.sum(F.col("c") * off).over(every), "q": F.sum(F.col("c") * off * off).over(every)})
        spread = F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1))
        wide = wide.withColumn("h", silverman(F.when(F.col("hi") > F.col("lo"), F.sqrt(spread)), F.col("n")))
    else:
        wide = counted.withColumns(span | {"h": F.lit(float(h))})
    # The windows dealt by track and sorted; the sort named here costs nothing more.
    return wide.select(*keys, "x", "c", "lo", "hi", "n", "h").sortWithinPartitions(*keys)


def _at(i: Column, kernel_sum: Column, grid: int) -> list[Column]:
    """x_log, x_linear and y of grid point i."""
    x_log = F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(float(max(1, grid - 1)))
    y = F.coalesce(F.try_divide(kernel_sum, F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))), F.lit(float("nan")))
    return [x_log.alias("x_log"), F.exp(x_log).alias("x_linear"), y.alias("y")]


def kde_peaks(values: DataFrame, column: str) -> DataFrame:
    """peaks() of kde(), without a row for any other grid point."""
    found = kernels(values, column).select("track_id", "lo", "hi", "n", "h", "sums", F.explode("tops").alias("grid_i"))
    return found.select("track_id", "grid_i", *_at(F.col("grid_i"), F.get("sums", F.col("grid_i")), GRID))


#: Kinds of values that a chart shows, as sampling.series() numbers them.
KINDS = ("time", "distance")
_FIGURES = "lo double, hi double, n bigint, h double, sums array<double>, tops array<int>"
_SUMS = f"track_id string, {_FIGURES}"
#: Values of one track whose kernels are held at once, and tracks of a batch of results.
_VALUES, _TRACKS = 2048, 512


def _tops(sums: np.ndarray, over: float) -> np.ndarray:
    """Indices of sums / over that are above both neighbours; divided as for y, so that the same ones are equal."""
    if not over:
        return np.zeros(0, np.int64)
    up = np.diff(sums / over)
    return np.flatnonzero((up[:-1] > 0) & (up[1:] < 0)) + 1


def _kernel_sums(grid: int, kinds: tuple[str, ...] = ()):
    """Distinct logs with counts, sorted by track and kind, with what is known of their group, to a row per track with its kernel sums over the grid; of
    several kinds, in a struct for each. A track may span batches; one array a kind is held for the open track."""
    at = np.arange(grid) / max(1, grid - 1)
    names = ["lo", "hi", "n", "h", "sums", "tops"]
    none = (0.0, 0.0, 0, 0.0, np.zeros(0))

    def figures(groups: list[tuple | None]) -> list[pa.Array]:
        whole = [g or none for g in groups]
        known = [pa.array([g[i] for g in whole], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(g[4]) for g in whole)]), pa.int32()), pa.array(np.concatenate([g[4] for g in whole])))
        return [*known, lists, pa.array([_tops(a, n * h * math.sqrt(2 * math.pi)) for _, _, n, h, a in whole], pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracks, done = [], []  # of each track, its groups by kind: lo, hi, n, h and the sums

        def made() -> pa.RecordBatch:
            columns, ids = [figures([d[k] for d in done]) for k in range(max(1, len(kinds)))], pa.array(tracks, pa.string())
            absent = [pa.array([d[k] is None for d in done]) for k in range(len(kinds))]
            tracks.clear()
            done.clear()
            if not kinds:
                return pa.RecordBatch.from_arrays([ids, *columns[0]], ["track_id", *names])
            return pa.RecordBatch.from_arrays([ids, *(pa.StructArray.from_arrays(c, names, mask=a) for c, a in zip(columns, absent, strict=True))], ["track_id", *kinds])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("track_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            x, c, lo, hi, n, h, kind = (batch.column(k).to_numpy() for k in ("x", "c", "lo", "hi", "n", "h", "kind"))
            edge = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            c = c.astype(float)
            for a, b in zip(edge, edge[1:], strict=False):
                track = batch.column("track_id")[a].as_py()
                if not done or tracks[-1] != track:
                    if len(done) >= _TRACKS:
                        yield made()
                    tracks.append(track)
                    done.append([None] * max(1, len(kinds)))
                if done[-1][kind[a]] is None:
                    done[-1][kind[a]] = (float(lo[a]), float(hi[a]), int(n[a]), float(h[a]), np.zeros(grid))
                sums = done[-1][kind[a]][4]
                points = (lo[a] + (hi[a] - lo[a]) * at)[:, None]
                for k in range(a, b, _VALUES):
                    e = min(b, k + _VALUES)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        u = (points - x[None, k:e]) / h[a]
                        u *= u
                        u *= -0.5
                        np.exp(u, out=u)
                    sums += (u if h[a] else np.nan_to_num(u)) @ c[k:e]
        if done:
            yield made()

    return run


def peaks(curve: DataFrame) -> DataFrame:
    """Grid points above both neighbours."""
    w = Window.partitionBy("track_id").orderBy("grid_i")
    near = curve.withColumns({"before": F.lag("y").over(w), "after": F.lead("y").over(w)})
    return near.where("y > before and y > after").drop("before", "after")


def nearest_grid(curve: DataFrame, x_log: float) -> DataFrame:
    """Each track's grid point nearest to a cursor at x_log, the first of equally near ones."""
    best = curve.groupBy("track_id").agg(F.min_by(F.struct("grid_i", "x_log", "x_linear", "y"), F.struct(F.abs(F.col("x_log") - F.lit(float(x_log))), "grid_i")).alias("p"))
    return best.select("track_id", "p.*")


def _both(time_values: DataFrame, distance_values: DataFrame, whole: bool) -> DataFrame:
    """Per track both kinds' bandwidths and numbers of peaks and, if whole, what their curves are made of; each density is worked out once."""

    def one(values: DataFrame, column: str, name: str) -> DataFrame:
        own = [F.struct("lo", "hi", "n", "h", "sums", "tops").alias(name)] if whole else []
        return kernels(values, column).select("track_id", F.exp("h").alias(f"{name}_bandwidth"), F.size("tops").cast("bigint").alias(f"{name}_peaks"), *own)

    both = one(time_values, "dt_sec", "time").join(one(distance_values, "dd_meters", "distance"), "track_id", "full_outer")
    peaks_of = {c: F.coalesce(c, F.lit(0)) for c in ("time_peaks", "distance_peaks")}
    return both.withColumns({**peaks_of, "distance_bandwidth": F.coalesce("distance_bandwidth", F.lit(1.0))})


OVERVIEW = ("track_id", "time_bandwidth", "time_peaks", "distance_bandwidth", "distance_peaks")


def _told(both: DataFrame) -> DataFrame:
    """kernels_by_kind() with the columns of OVERVIEW."""
    h = {f"{k}_bandwidth": F.exp(f"{k}.h") for k in KINDS}
    tops = {f"{k}_peaks": F.coalesce(F.when(F.col(k).isNotNull(), F.size(f"{k}.tops")), F.lit(0)).cast("bigint") for k in KINDS}
    return both.withColumns(h | tops).withColumn("distance_bandwidth", F.coalesce("distance_bandwidth", F.lit(1.0)))


def overview(time_values: DataFrame, distance_values: DataFrame) -> DataFrame:
    """track_id with bandwidths, in the unit of the values, and numbers of peaks of both densities. Without positive values of a kind there are
    0 peaks; the bandwidth is null for times and 1 for distances."""
    return _both(time_values, distance_values, False).select(*OVERVIEW)


def series_overview(series: DataFrame) -> DataFrame:
    """overview() of both kinds of sampling.series(), which is read once."""
    return _told(kernels_by_kind(series)).select(*OVERVIEW)


def curves(time_values: DataFrame, distance_values: DataFrame) -> DataFrame:
    """overview() with each density as an array of its grid points, time_curve and distance_curve, and of those that are peaks (time_tops,
    distance_tops); empty where a track has no positive values of a kind."""
    return _drawn(_both(time_values, distance_values, True))


def series_curves(series: DataFrame) -> DataFrame:
    """curves() of both kinds of sampling.series(), which is read once."""
    return _drawn(_told(kernels_by_kind(series)))


def _drawn(out: DataFrame) -> DataFrame:
    names = []
    for name in KINDS:
        own = out.select("*", f"{name}.*")
        point = lambda v, i: F.struct(i.alias("grid_i"), *_at(i, v, GRID))
        top = lambda i: point(F.get("sums", i), i)
        own = own.withColumns({f"{name}_curve": F.transform("sums", point), f"{name}_tops": F.transform("tops", top)})
        out = own.drop("lo", "hi", "n", "h", "sums", "tops", name)
        names += [f"{name}_curve", f"{name}_tops"]
    return out.select(*OVERVIEW, *(F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in names))


def bandwidth_range(curve: DataFrame, bandwidths: DataFrame) -> DataFrame:
    """track_id, low, high, step of a control for the bandwidth h: a fiftieth to a fifth of the range of logs; where h lies outside, half or twice h."""
    span = curve.groupBy("track_id").agg((F.max("x_log") - F.min("x_log")).alias("span"))
    low, high, h = F.greatest(F.lit(1e-3), F.col("span") / 50), F.col("span") / 5, F.col("h")
    low = F.when(h < low, F.greatest(F.lit(1e-3), h / 2)).otherwise(low)
    high = F.when(h > high, h * 2).otherwise(high)
    return span.join(bandwidths, "track_id").select("track_id", low.alias("low"), high.alias("high"), F.greatest(F.lit(1e-4), (high - low) / 1000).alias("step"))


def viewport(pairs: DataFrame, times: tuple[float, float], distances: tuple[float, float]) -> DataFrame:
    """Pairs whose logs lie in both ranges, borders included."""
    return pairs.where(safe_log(F.col("dt_sec")).between(*times) & safe_log(F.col("dd_meters")).between(*distances))


def domains(pairs: DataFrame) -> DataFrame:
    """Per track the extent of both axes of a log-log chart of joint pairs; each begins at the log of FLOOR, so that zeros have a place."""
    low = lambda c: F.least(F.lit(math.log(FLOOR)), F.min(safe_log(F.col(c)))).alias(f"min_{c}")
    high = lambda c: F.max(safe_log(F.col(c))).alias(f"max_{c}")
    return pairs.groupBy("track_id").agg(*(f(c) for c in ("dt_sec", "dd_meters") for f in (low, high)))


def window_size(n: Column) -> Column:
    """How many pairs a sequence chart shows of n."""
    return F.when(n > 200, F.lit(200)).otherwise(F.least(n, F.greatest(F.lit(30), F.round(n * 0.7)))).cast("bigint")


def sequence_window(pairs: DataFrame, start: int = 0) -> DataFrame:
    """The pairs of each track that a sequence chart shows from place start (moved back if too few follow), with shade: 0 to 1 by the log of
    the distance over the track's largest."""
    w = Window.partitionBy("track_id")
    placed = pairs.withColumns({"pos": F.row_number().over(w.orderBy("to_index")) - 1, "n": F.count(F.lit(1)).over(w), "most": F.max("dd_meters").over(w)})
    size = window_size(F.col("n"))
    begin = F.greatest(F.lit(0), F.least(F.lit(start), F.col("n") - size))
    shade = F.when(F.col("most") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p("dd_meters") / F.log1p("most")))).otherwise(0.0)
    return placed.where((F.col("pos") >= begin) & (F.col("pos") < begin + size)).select("track_id", "pos", "from_index", "to_index", "dt_sec", "dd_meters", shade.alias("shade"))


def legend(pairs: DataFrame) -> DataFrame:
    """Distances at 0, 25, 50, 75 and 100 % of the log1p scale of each track; the 0 alone where the largest is 0."""
    most = pairs.groupBy("track_id").agg(F.max("dd_meters").alias("most"))
    at = lambda q: F.struct(F.lit(q).alias("share"), (F.col("most") if q == 1 else F.expm1(F.log1p("most") * q)).alias("meters"))
    anchors = F.when(F.col("most") > 0, F.array(*map(at, (0.0, 0.25, 0.5, 0.75, 1.0)))).otherwise(F.array(at(0.0)))
    return most.select("track_id", F.explode(anchors).alias("x")).select("track_id", "x.*")


def tick(x: Column, about: bool = False) -> Column:
    """A number as chart text: 0 as such, whole from 1, else two decimals; about: all but 0 after a tilde."""
    text = F.when(F.abs(x) >= 1, F.floor(x + 0.5).cast("bigint").cast("string")).otherwise(fixed(x, 2))
    return F.when(x == 0, "0").otherwise(F.concat(F.lit("~"), text) if about else text)


def legend_labels(pairs: DataFrame) -> DataFrame:
    """legend() with its texts: between both ends, about so many metres."""
    between = (F.col("share") > 0) & (F.col("share") < 1)
    text = F.when(between, tick(F.col("meters"), about=True)).otherwise(tick(F.col("meters")))
    return legend(pairs).select("track_id", "share", "meters", F.concat(text, F.lit(" m")).alias("label"))
