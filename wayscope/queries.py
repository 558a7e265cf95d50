"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it.

Tracks come from events (a track per user, anomalies at fixed places) and from orders (a track per customer, dates as they are).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify as _classify
from .operators import clustering, density, drill, ingest, motion, sampling, temporal
from .operators.medians import exact_medians
from .operators.nearest import boxed, nearest_point
from .operators.segmented import classify_segmented
from .plans import audit_documents, delta_documents, held, prevalence, statuses, to_json_rows, track_metrics
from .schemas import KINDS
from .sources import event_points, order_points
from .sources.tables import EVENT_SQL, ORDER_SQL

BLOCK = (10, 60)
CENTRE, REACH = 50, 20
CURSOR = 8.0
VIEW = (8.0, 10.5), (6.0, 7.0)
DIGITS = 6
#: Points of a chunk where tracks are classified in chunks; the driver's tracks are short, so that each one has several.
CHUNK = 32
#: Levels of the grid that nearest points are looked up in; the driver's tracks have some hundred points.
LEVELS = 1
#: Rounds of histograms that medians are found by.
ROUNDS = 2


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.points(event_points(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classify.classify(_points(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classify.classify(ingest.points(order_points(spark, sf_dir)))


def _segmented(points: DataFrame) -> DataFrame:
    return classify_segmented(points, CHUNK)


def _classes(classified: DataFrame) -> DataFrame:
    return classified.select("track_id", "gpx_index", "ts_ms", "ts_state", "temporal_class", "anchor_ms", "depth_ms", "dt_ms", F.col("last.gpx_index").alias("last_index"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _m(a: str, b: str, c: str, d: str) -> str:
    """Haversine in SQL."""
    h = f"pow(sin(({c} - {a}) * pi() / 180 / 2), 2) + cos({a} * pi() / 180) * cos({c} * pi() / 180) * pow(sin(({d} - {b}) * pi() / 180 / 2), 2)"
    return f"(6371000 * 2 * atan2(sqrt({h}), sqrt(greatest(0, 1 - ({h})))))"


_PTS = """, chk AS (SELECT *, TRY_CAST(raw_lat AS DOUBLE) AS lat, TRY_CAST(raw_lon AS DOUBLE) AS lon FROM found),
    pts AS (SELECT track_id, gpx_index, lat, lon, raw_time AS time_raw, CASE WHEN raw_time NOT LIKE 'INVALID%' THEN epoch_ms(CAST(replace(raw_time, 'Z', '') AS TIMESTAMP)) END AS ts_ms
            FROM chk WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"""
_CLS = _PTS + f""", lk AS (SELECT *, max(ts_ms) OVER b AS anchor_ms, last_value(ts_ms IGNORE NULLS) OVER b AS last_ms, last_value(CASE WHEN ts_ms IS NOT NULL THEN gpx_index END IGNORE NULLS) OVER b AS last_index,
            last_value(CASE WHEN ts_ms IS NOT NULL THEN lat END IGNORE NULLS) OVER b AS last_lat, last_value(CASE WHEN ts_ms IS NOT NULL THEN lon END IGNORE NULLS) OVER b AS last_lon,
            lag(gpx_index) OVER o AS prev_index, lag(lat) OVER o AS prev_lat, lag(lon) OVER o AS prev_lon
            FROM pts WINDOW o AS (PARTITION BY track_id ORDER BY gpx_index), b AS (PARTITION BY track_id ORDER BY gpx_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ck AS (SELECT *, CASE WHEN time_raw IS NULL THEN 'missing' WHEN ts_ms IS NULL THEN 'unparsable' WHEN last_ms IS NULL THEN 'first' WHEN ts_ms = last_ms THEN 'duplicate' WHEN ts_ms >= anchor_ms THEN 'forward' ELSE 'backtracking' END AS k FROM lk),
    cls AS (SELECT *, CASE WHEN k = 'backtracking' THEN anchor_ms - ts_ms END AS depth_ms, ts_ms - last_ms AS dt_ms, {_m('prev_lat', 'prev_lon', 'lat', 'lon')} AS prev_m, {_m('last_lat', 'last_lon', 'lat', 'lon')} AS anchor_m,
            CASE k WHEN 'missing' THEN sum(CASE WHEN k <> 'missing' THEN 1 ELSE 0 END) OVER u WHEN 'unparsable' THEN sum(CASE WHEN ts_ms IS NOT NULL THEN 1 ELSE 0 END) OVER u
                   WHEN 'duplicate' THEN sum(CASE WHEN k IN ('forward', 'backtracking') THEN 1 ELSE 0 END) OVER u WHEN 'backtracking' THEN sum(CASE WHEN k = 'forward' THEN 1 ELSE 0 END) OVER u END AS run
            FROM ck WINDOW u AS (PARTITION BY track_id ORDER BY gpx_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_RUNS = """, runs AS (SELECT track_id, k AS kind, run, min(gpx_index) AS start_index, max(gpx_index) AS end_index, count(*) AS length, arg_min(ts_ms, CASE WHEN ts_ms IS NOT NULL THEN gpx_index END) AS first_ms, max(depth_ms) AS max_depth_ms,
            arg_min(gpx_index, gpx_index) AS gpx_index, any_value(last_index) AS prev_index, any_value(time_raw) AS time_raw, any_value(ts_ms) AS ts_ms, any_value(last_ms) AS prev_ms
            FROM cls WHERE k IN ('missing', 'unparsable', 'duplicate', 'backtracking') GROUP BY track_id, k, run)"""
_JOINT = """, joint AS (SELECT track_id, prev_index AS from_index, gpx_index AS to_index, dt_ms / 1000.0::DOUBLE AS dt_sec, prev_m AS dd_meters FROM cls WHERE last_index = prev_index AND dt_ms > 0 AND prev_m > 0)"""

#: A step per value: of a track's deltas as sorted and as they come, the cluster that each joins, and the open clusters' values in order.
_CENTRE = "({0}[(len({0}) + 1) // 2] + {0}[len({0}) // 2 + 1]) / 2"
_WALK = f""", dl AS (SELECT track_id, list(dt_ms / 1000.0::DOUBLE ORDER BY dt_ms) AS v, list(dt_ms / 1000.0::DOUBLE ORDER BY gpx_index) AS q FROM cls WHERE dt_ms > 0 GROUP BY track_id),
    wk AS (SELECT track_id, v, q, 1 AS i, 0 AS cluster, [v[1]] AS own, v[1] AS x, 0.0::DOUBLE AS rel, 0.0::DOUBLE AS gap, 1 AS seq, [q[1]] AS seen FROM dl
           UNION ALL SELECT track_id, v, q, i + 1, CASE WHEN g / c < {clustering.ALPHA} THEN cluster ELSE cluster + 1 END, CASE WHEN g / c < {clustering.ALPHA} THEN list_append(own, a) ELSE [a] END, a,
                            CASE WHEN g / c < {clustering.ALPHA} THEN g / c ELSE 0 END, CASE WHEN g / c < {clustering.ALPHA} THEN g ELSE 0 END,
                            CASE WHEN abs(b - m) / m < {clustering.ALPHA} THEN seq ELSE seq + 1 END, CASE WHEN abs(b - m) / m < {clustering.ALPHA} THEN list_sort(list_append(seen, b)) ELSE [b] END
                     FROM (SELECT *, abs(a - c) AS g FROM (SELECT *, v[i + 1] AS a, q[i + 1] AS b, {_CENTRE.format("own")} AS c, {_CENTRE.format("seen")} AS m FROM wk WHERE i < len(v)))),
    fc AS (SELECT track_id, cluster, {_CENTRE.format("arg_max(own, i)")} AS centre FROM wk GROUP BY track_id, cluster),
    cr AS (SELECT wk.*, centre, abs(x - centre) AS far FROM wk JOIN fc USING (track_id, cluster)),
    nm AS (SELECT track_id, CAST(max(cluster) + 1 AS BIGINT) AS sorted_n, CAST(max(seq) AS BIGINT) AS seq_n, count(*) AS n, avg(far) AS mean_far, max(far) AS max_far, avg(far / centre) AS mean_rel, max(far / centre) AS max_rel,
                  count(*) FILTER (far > 0) AS moved FROM cr GROUP BY track_id)"""
_CLUSTERS = """SELECT track_id, CAST(cluster AS INTEGER) AS cluster, round(any_value(centre), 6) AS "centerSec", count(*) AS "count", round(count(*) / sum(count(*)) OVER (PARTITION BY track_id), 6) AS "clusterShareOfTotalDeltas",
    round(min(x), 6) AS "minSec", round(max(x), 6) AS "maxSec", round(max(x) - min(x), 6) AS "spreadSec", round(avg(rel), 6) AS "meanInsertionRelativeDeviation", round(max(rel), 6) AS "maxInsertionRelativeDeviation",
    round(avg(gap), 6) AS "meanInsertionAbsoluteDeviationSec", round(max(gap), 6) AS "maxInsertionAbsoluteDeviationSec", round(avg(far), 6) AS "finalMeanAbsoluteDeviationSec", round(max(far), 6) AS "finalMaxAbsoluteDeviationSec",
    round(avg(far / centre), 6) AS "finalMeanRelativeDeviation", round(max(far / centre), 6) AS "finalMaxRelativeDeviation", round((max(x) - min(x)) / any_value(centre), 6) AS "finalSpreadOverCenterRatio" FROM cr GROUP BY track_id, cluster"""
_NORMAL = f"""SELECT track_id, {clustering.ALPHA}::DOUBLE AS "insertionRelativeThreshold", sorted_n AS "sortedClusterCount", seq_n AS "sequentialClusterCount", round(mean_far, 6) AS "meanFinalAbsoluteDeviationSec",
    round(max_far, 6) AS "maxFinalAbsoluteDeviationSec", round(mean_rel, 6) AS "meanFinalRelativeDeviation", round(max_rel, 6) AS "maxFinalRelativeDeviation", round(sorted_n / n, 6) AS "sortedClusterCountOverTotalDeltasRatio",
    round(seq_n / n, 6) AS "sequentialClusterCountOverTotalDeltasRatio", round(CASE WHEN sorted_n <= 1 THEN 1 ELSE seq_n / sorted_n END, 6) AS "sequentialOverSortedClusterCountRatio",
    moved AS "nonZeroFinalDeviationCount", n - moved AS "zeroFinalDeviationCount" FROM nm"""
#: What each figure of a document is, counted from the points themselves.
_METRICS = """SELECT track_id, total_points, coalesce(valid, 0) AS valid_points, total_points - coalesce(valid, 0) AS rejected_points, false AS multiple_types, round(duration_ms / 1000.0::DOUBLE, 6) AS duration_sec,
    coalesce(parseable, 0) AS parseable, coalesce(forward, 0) AS forward, coalesce(missing, 0) AS missing, coalesce(unparsable, 0) AS unparsable, coalesce(duplicate, 0) AS duplicate, coalesce(backtracking, 0) AS backtracking,
    coalesce(missing_longest, 0) AS missing_longest, coalesce(unparsable_longest, 0) AS unparsable_longest, coalesce(duplicate_longest, 0) AS duplicate_longest, max_depth_ms, coalesce(positive, 0) AS positive_deltas,
    coalesce(non_positive, 0) AS non_positive, coalesce(sorted_n, 0) AS sorted_clusters, coalesce(seq_n, 0) AS sequential_clusters, coalesce(geometry, 0) AS geometry_deltas, coalesce(pairs, 0) AS motion_pairs,
    coalesce(motion_forward, 0) AS motion_forward, coalesce(backward, 0) AS backward_pairs, round(CASE WHEN up + down > 0 THEN down / (up + down) ELSE 0 END, 6) AS invalid_share
    FROM (SELECT track_id, count(*) AS total_points FROM found GROUP BY track_id)
    LEFT JOIN (SELECT track_id, count(*) AS valid, count(ts_ms) AS parseable, max(depth_ms) AS max_depth_ms, arg_max(ts_ms, CASE WHEN ts_ms IS NOT NULL THEN gpx_index END) - arg_min(ts_ms, CASE WHEN ts_ms IS NOT NULL THEN gpx_index END) AS duration_ms,
        count(*) FILTER (k = 'forward') AS forward, count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'unparsable') AS unparsable, count(*) FILTER (k = 'duplicate') AS duplicate,
        count(*) FILTER (k = 'backtracking') AS backtracking, count(*) FILTER (dt_ms > 0) AS positive, count(*) FILTER (dt_ms <= 0) AS non_positive, count(*) FILTER (prev_m >= 0) AS geometry, count(last_index) AS pairs,
        count(*) FILTER (dt_ms > 0) AS motion_forward, count(*) FILTER (dt_ms < 0) AS backward, coalesce(sum(dt_ms) FILTER (dt_ms > 0), 0) AS up, coalesce(sum(-dt_ms) FILTER (dt_ms < 0), 0) AS down FROM cls GROUP BY track_id) USING (track_id)
    LEFT JOIN (SELECT track_id, max(length) FILTER (kind = 'missing') AS missing_longest, max(length) FILTER (kind = 'unparsable') AS unparsable_longest, max(length) FILTER (kind = 'duplicate') AS duplicate_longest
        FROM runs WHERE length > 1 GROUP BY track_id) USING (track_id)
    LEFT JOIN nm USING (track_id)"""
#: Seconds as JSON has them: from ten million on with an exponent.
_SEC_TEXT = """CASE WHEN dt_ms < 10000000000 THEN CAST(dt_ms / 1000.0::DOUBLE AS VARCHAR)
    ELSE left(CAST(dt_ms AS VARCHAR), 1) || '.' || coalesce(nullif(rtrim(substr(CAST(dt_ms AS VARCHAR), 2), '0'), ''), '0') || 'E' || (len(CAST(dt_ms AS VARCHAR)) - 4) END"""
_TIME_EXPORT = f"""SELECT track_id, '{{"deltas":[' || string_agg('{{"fromIndex":' || last_index || ',"toIndex":' || gpx_index || ',"dtSec":' || {_SEC_TEXT} || '}}', ',' ORDER BY gpx_index) || '],"count":' || count(*) || '}}' AS json
    FROM cls WHERE dt_ms > 0 GROUP BY track_id"""


def _events(sql: str, more: str = "") -> str:
    return f"WITH RECURSIVE {EVENT_SQL}{_CLS}{more} {sql}"


def _of_orders(sql: str, more: str = "") -> str:
    return f"WITH {ORDER_SQL}{_CLS}{more} {sql}"


_SUMMARY = """SELECT track_id, count(*) AS points_evaluated, count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'unparsable') AS unparsable, count(*) FILTER (k = 'duplicate') AS duplicate,
    count(*) FILTER (k = 'backtracking') AS backtracking, count(*) FILTER (k = 'forward') AS forward, count(ts_ms) AS parseable, max(depth_ms) AS max_depth_ms,
    arg_max(ts_ms, CASE WHEN ts_ms IS NOT NULL THEN gpx_index END) - arg_min(ts_ms, CASE WHEN ts_ms IS NOT NULL THEN gpx_index END) AS duration_ms,
    round(count(*) FILTER (k = 'missing') / count(*), 6) AS missing_ratio, round(count(*) FILTER (k = 'unparsable') / count(*), 6) AS unparsable_ratio, round(count(*) FILTER (k = 'duplicate') / count(*), 6) AS duplicate_ratio FROM cls GROUP BY track_id"""
_MOTION = """, mp AS (SELECT track_id, last_index AS from_index, gpx_index AS to_index, CASE WHEN time_raw IS NULL THEN 'missingTimestamp' WHEN ts_ms IS NULL THEN 'unparsableTimestamp' WHEN dt_ms > 0 THEN 'forward' WHEN dt_ms = 0 THEN 'zeroTimeDelta' ELSE 'backward' END AS pair_class,
    dt_ms / 1000.0::DOUBLE AS dt_sec, anchor_m AS dd_meters, time_raw FROM cls WHERE last_index IS NOT NULL)"""
_KDE = """, v AS (SELECT track_id, ln(dt_ms / 1000.0::DOUBLE) AS x FROM cls WHERE dt_ms > 0), vc AS (SELECT track_id, x, count(*) AS c FROM v GROUP BY ALL),
    s AS (SELECT track_id, min(x) AS lo, max(x) AS hi, count(*) AS n, 1.06 * coalesce(nullif(stddev_samp(x), 0), 1) * pow(count(*), -0.2) AS h FROM v GROUP BY track_id),
    g AS (SELECT track_id, n, h, i AS grid_i, lo + (hi - lo) * i / 199.0::DOUBLE AS x_log FROM s, generate_series(0, 199) AS t(i)),
    kde AS (SELECT g.track_id, CAST(grid_i AS INTEGER) AS grid_i, x_log, sum(exp(-0.5 * pow((x_log - x) / h, 2)) * c) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y FROM g JOIN vc USING (track_id) GROUP BY g.track_id, grid_i, x_log)"""


def _deltas(s: SparkSession, d: str) -> DataFrame:
    return sampling.time_deltas(_classified(s, d))


def _normalized(s: SparkSession, d: str) -> DataFrame:
    deltas = _deltas(s, d)
    return _rounded(sampling.normalization(clustering.cluster_values(deltas), clustering.sequential_clusters(deltas)))


def _primary(s: SparkSession, d: str) -> DataFrame:
    return sampling.primary_distances(_classified(s, d))


def _joint(s: SparkSession, d: str) -> DataFrame:
    return sampling.joint_pairs(_classified(s, d))


def _probes(points: DataFrame) -> DataFrame:
    b = drill.bounds(points)
    return b.select(F.col("track_id").alias("probe_id"), "track_id", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return nearest_point(boxed(p), _probes(p), LEVELS)


#: What is expected of every track of events: description, key, kind, value, and whether a failure is put up with.
EXPECTED = (
    ("enough points", "total_points", "atLeast", 10.0, False), ("times are missing", "missing", "atLeast", 1.0, True), ("times fall back", "backtracking", "atLeast", 1.0, True),
    ("one kind of points", "multiple_types", "eq", 0.0, False), ("few long blocks", "missing_longest", "eq", 0.0, True),
)


def _held(s: SparkSession, d: str) -> DataFrame:
    m = track_metrics(event_points(s, d))
    rows = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(e, ("description", "key", "kind", "value", "soft"), strict=True))) for e in EXPECTED))
    return held(m, event_points(s, d).select("track_id").distinct().select("track_id", F.explode(rows).alias("e")).select("track_id", "e.*"))


def _medians(s: SparkSession, d: str) -> DataFrame:
    """Medians of times and speeds of forward pairs."""
    pairs = motion.pairs(_classified(s, d)).where("pair_class = 'forward'")
    both = pairs.select("track_id", F.explode(F.array(F.struct(F.lit("dt_sec").alias("figure"), F.col("dt_sec").alias("x")), F.struct(F.lit("mps").alias("figure"), (F.col("dd_meters") / F.col("dt_sec")).alias("x")))).alias("v"))
    return _rounded(exact_medians(both.select("track_id", "v.figure", "v.x"), ["track_id", "figure"], "x", ROUNDS))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return audit_documents(event_points(s, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "temporal_counts": lambda s, d: _rounded(temporal.summary(_classified(s, d))),
    "ingest_counts": lambda s, d: ingest.counts(event_points(s, d)),
    "ingest_rejections": lambda s, d: ingest.rejected(event_points(s, d)).select("track_id", "gpx_index", "point_type", "raw_lat", "raw_lon", "raw_time", "reason"),
    "point_classes": lambda s, d: _classes(_classified(s, d)),
    "point_classes_segmented": lambda s, d: _classes(_segmented(_points(s, d))),
    "temporal_blocks_segmented": lambda s, d: temporal.blocks(_segmented(_points(s, d))),
    "temporal_blocks_orders_segmented": lambda s, d: temporal.blocks(_segmented(ingest.points(order_points(s, d)))),
    "temporal_isolated": lambda s, d: temporal.isolated(_classified(s, d)),
    "temporal_blocks_orders": lambda s, d: temporal.blocks(_orders(s, d)),
    "temporal_counts_orders": lambda s, d: _rounded(temporal.summary(_orders(s, d))),
    "anomaly_prevalence": lambda s, d: _rounded(prevalence(_classified(s, d))),
    "sampling_context": lambda s, d: _rounded(sampling.context(_classified(s, d))),
    "time_deltas": _deltas,
    "non_positive_pairs": lambda s, d: sampling.non_positive_pairs(_classified(s, d)),
    "distance_deltas": lambda s, d: _rounded(sampling.distance_deltas(_classified(s, d))),
    "primary_distances": lambda s, d: _rounded(sampling.primary_distances(_classified(s, d))),
    "joint_pairs": lambda s, d: _rounded(_joint(s, d)),
    "sampling_clusters": lambda s, d: _rounded(clustering.descriptors(clustering.cluster_values(_deltas(s, d)))),
    "sampling_cluster_numbers": lambda s, d: _rounded(clustering.cluster_numbers(_deltas(s, d)).withColumn("cluster", F.col("cluster").cast("int"))),
    "sampling_normalization": _normalized,
    "motion_pairs": lambda s, d: _rounded(motion.pairs(_classified(s, d))),
    "motion_summary": lambda s, d: _rounded(motion.summary(motion.pairs(_classified(s, d)))),
    "motion_summary_orders": lambda s, d: _rounded(motion.summary(motion.pairs(_orders(s, d)))),
    "motion_rejections": lambda s, d: _rounded(motion.pairs(_classified(s, d)).where("pair_class <> 'forward'")),
    "motion_medians": _medians,
    "local_block": lambda s, d: _rounded(drill.local_block(_points(s, d), *BLOCK)),
    "route_bounds": lambda s, d: drill.bounds(_points(s, d)),
    "route_polyline": lambda s, d: drill.polyline(_points(s, d)),
    "point_neighbourhood": lambda s, d: drill.neighbourhood(_points(s, d), CENTRE, REACH),
    "nearest_point": _nearest,
    "bandwidth": lambda s, d: _rounded(density.bandwidth(_deltas(s, d), "dt_sec")),
    "kde_curve": lambda s, d: _rounded(density.kde(_deltas(s, d), "dt_sec")),
    "bandwidth_distance": lambda s, d: _rounded(density.bandwidth(_primary(s, d), "dd_meters")),
    "kde_distance_curve": lambda s, d: _rounded(density.kde(_primary(s, d), "dd_meters")),
    "kde_nearest_grid": lambda s, d: _rounded(density.nearest_grid(density.kde(_deltas(s, d), "dt_sec"), CURSOR)),
    "density_overview": lambda s, d: _rounded(density.series_overview(sampling.series(_classified(s, d)))),
    "density_curves": lambda s, d: density.series_curves(sampling.series(_classified(s, d))),
    "chart_ticks": lambda s, d: density.legend_labels(_joint(s, d)).select("track_id", "share", F.col("label").alias("tick")),
    "export_distance_deltas": lambda s, d: delta_documents(sampling.distance_deltas(_classified(s, d))),
    "kde_distance_peaks": lambda s, d: _rounded(density.kde_peaks(_primary(s, d), "dd_meters")),
    "kde_peaks": lambda s, d: _rounded(density.kde_peaks(_deltas(s, d), "dt_sec")),
    "bandwidth_range": lambda s, d: _rounded(density.bandwidth_range(density.kde(_deltas(s, d), "dt_sec"), density.bandwidth(_deltas(s, d), "dt_sec"))),
    "chart_domains": lambda s, d: _rounded(density.domains(_joint(s, d))),
    "chart_viewport": lambda s, d: _rounded(density.viewport(_joint(s, d), *VIEW)),
    "chart_sequence": lambda s, d: _rounded(density.sequence_window(_joint(s, d))),
    "chart_legend": lambda s, d: _rounded(density.legend(_joint(s, d))),
    "expected_figures": lambda s, d: _rounded(_held(s, d)),
    "expected_statuses": lambda s, d: statuses(_held(s, d)),
    "audit_metrics": lambda s, d: _rounded(track_metrics(event_points(s, d))),
    "audit_documents": lambda s, d: to_json_rows(_documents(s, d)),
    "export_time_deltas": lambda s, d: delta_documents(_deltas(s, d)),
    "export_joint_pairs": lambda s, d: delta_documents(_joint(s, d), "pairs"),
} | {f"temporal_blocks_{k}": (lambda s, d, k=k: temporal.blocks(_classified(s, d)).where(F.col("kind") == k)) for k in KINDS}

_BLOCKS = "SELECT track_id, kind, start_index, end_index, length, first_ms, max_depth_ms FROM runs WHERE length > 1"
_MOTION_SUM = """SELECT *, CASE WHEN valid_sec + invalid_sec > 0 THEN round(invalid_sec / (valid_sec + invalid_sec), 6) ELSE 0 END AS invalid_share FROM (SELECT track_id, count(*) AS pairs, count(*) FILTER (pair_class = 'forward') AS forward,
    count(*) FILTER (pair_class = 'missingTimestamp') AS "missingTimestamp", count(*) FILTER (pair_class = 'unparsableTimestamp') AS "unparsableTimestamp", 0::BIGINT AS "nonFiniteDistance", count(*) FILTER (pair_class = 'backward') AS backward, count(*) FILTER (pair_class = 'zeroTimeDelta') AS "zeroTimeDelta",
    round(coalesce(sum(dt_sec) FILTER (pair_class = 'forward'), 0), 6) AS valid_sec, round(coalesce(sum(-dt_sec) FILTER (pair_class = 'backward'), 0), 6) AS invalid_sec, round(coalesce(sum(dd_meters) FILTER (pair_class = 'forward'), 0), 6) AS meters,
    round(median(dd_meters / dt_sec) FILTER (pair_class = 'forward'), 6) AS median_mps, round(max(dd_meters / dt_sec) FILTER (pair_class = 'forward'), 6) AS max_mps,
    round(sum(dd_meters) FILTER (pair_class = 'forward') / sum(dt_sec) FILTER (pair_class = 'forward'), 6) AS mean_mps FROM mp GROUP BY track_id)"""
_PEAKS = "SELECT track_id, grid_i, round(x_log, 6) AS x_log, round(exp(x_log), 6) AS x_linear, round(y, 6) AS y FROM (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a FROM kde WINDOW w AS (PARTITION BY track_id ORDER BY grid_i)) WHERE y > b AND y > a"
_CURVE = "SELECT track_id, grid_i, round(x_log, 6) AS x_log, round(exp(x_log), 6) AS x_linear, round(y, 6) AS y FROM kde"
_OVERVIEW = f"SELECT track_id, round(exp(any_value(h)), 6) AS h, count(p.grid_i) AS peaks FROM s LEFT JOIN ({_PEAKS}) p USING (track_id) GROUP BY track_id"
_DISTANCES = "SELECT track_id, prev_index AS from_index, gpx_index AS to_index, round(prev_m, 6) AS dd_meters, coalesce(dt_ms > 0, false) AS on_progress FROM cls WHERE prev_index IS NOT NULL AND prev_m >= 0"
_KDE_M = _KDE.replace("SELECT track_id, ln(dt_ms / 1000.0::DOUBLE) AS x FROM cls WHERE dt_ms > 0", "SELECT track_id, ln(prev_m) AS x FROM cls JOIN (SELECT track_id, coalesce(bool_or(dt_ms > 0), false) AS moving FROM cls GROUP BY ALL) USING (track_id) WHERE prev_m > 0 AND (coalesce(dt_ms > 0, false) OR NOT moving)")

ORACLE: dict[str, str] = {
    "temporal_counts": _events(_SUMMARY),
    "temporal_counts_orders": _of_orders(_SUMMARY),
    "ingest_counts": f"""WITH {EVENT_SQL}{_PTS} SELECT track_id, count(*) AS total_points, count(*) FILTER (ok) AS valid_points, count(*) FILTER (NOT ok) AS rejected_points, 0::BIGINT AS wpt, 0::BIGINT AS rtept, count(*) AS trkpt,
        coalesce(bool_or(ok AND raw_time IS NOT NULL), false) AS has_any_timestamp_values, false AS has_multiple_point_types FROM (SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok FROM chk) GROUP BY track_id""",
    "ingest_rejections": f"""WITH {EVENT_SQL}{_PTS} SELECT track_id, gpx_index, 'trkpt' AS point_type, raw_lat, raw_lon, raw_time, CASE WHEN lat IS NULL THEN 'Invalid coordinates: lat="' || raw_lat || '", lon="' || raw_lon || '" (not parseable as numbers)'
        ELSE 'Coordinates out of valid range or non-finite: lat=' || lat || ' (must be -90 to 90), lon=' || regexp_replace(lon::VARCHAR, '[.]0$', '') || ' (must be -180 to 180)' END AS reason FROM chk WHERE NOT coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)""",
    "point_classes": _events("SELECT track_id, gpx_index, ts_ms, CASE WHEN time_raw IS NULL THEN 'missing' WHEN ts_ms IS NULL THEN 'unparsable' ELSE 'valid' END AS ts_state, k AS temporal_class, anchor_ms, depth_ms, dt_ms, last_index FROM cls"),
    "temporal_isolated": _events("SELECT track_id, kind, gpx_index, prev_index, time_raw, ts_ms, prev_ms FROM runs WHERE length = 1", _RUNS),
    "temporal_blocks_orders": _of_orders(_BLOCKS, _RUNS),
    "anomaly_prevalence": _events("""SELECT kind, (SELECT count(DISTINCT track_id) FROM cls) AS tracks, count(DISTINCT track_id) FILTER (k = kind) AS tracks_affected, count(*) FILTER (k = kind) AS points, round(count(*) FILTER (k = kind) / count(*), 6) AS share
        FROM cls, (VALUES ('missing'), ('unparsable'), ('duplicate'), ('backtracking')) AS t(kind) GROUP BY kind"""),
    "sampling_context": _events("""SELECT track_id, count(ts_ms) AS timestamped_points, count(dt_ms) AS timestamp_pairs, count(*) FILTER (dt_ms > 0) AS positive_deltas, count(*) FILTER (dt_ms <= 0) AS non_positive_pairs,
        round(min(CASE WHEN dt_ms > 0 THEN dt_ms / 1000.0::DOUBLE END) * 1000, 6) AS min_ms, round(max(CASE WHEN dt_ms > 0 THEN dt_ms / 1000.0::DOUBLE END) * 1000, 6) AS max_ms, round(median(CASE WHEN dt_ms > 0 THEN dt_ms / 1000.0::DOUBLE END) * 1000, 6) AS median_ms,
        count(prev_index) AS consecutive_pairs, count(*) FILTER (prev_index IS NOT NULL AND NOT coalesce(prev_m >= 0, false)) AS invalid_distances, count(*) FILTER (prev_m >= 0) AS geometry_deltas, count(*) FILTER (prev_m >= 0 AND dt_ms > 0) AS time_conditioned_deltas FROM cls GROUP BY track_id"""),
    "time_deltas": _events("SELECT track_id, last_index AS from_index, gpx_index AS to_index, dt_ms / 1000.0::DOUBLE AS dt_sec FROM cls WHERE dt_ms > 0"),
    "non_positive_pairs": _events("SELECT track_id, last_index AS from_index, gpx_index AS to_index, dt_ms AS delta_ms FROM cls WHERE dt_ms <= 0"),
    "distance_deltas": _events(_DISTANCES),
    "primary_distances": _events(f"SELECT d.* FROM ({_DISTANCES}) d JOIN (SELECT track_id, coalesce(bool_or(dt_ms > 0), false) AS moving FROM cls GROUP BY ALL) USING (track_id) WHERE on_progress OR NOT moving"),
    "joint_pairs": _events("SELECT track_id, from_index, to_index, round(dt_sec, 6) AS dt_sec, round(dd_meters, 6) AS dd_meters FROM joint", _JOINT),
    "sampling_clusters": _events(_CLUSTERS, _WALK),
    "sampling_cluster_numbers": _events("""SELECT d.track_id, last_index AS from_index, gpx_index AS to_index, round(dt_ms / 1000.0::DOUBLE, 6) AS dt_sec, CAST(cluster AS INTEGER) AS cluster, round(centre, 6) AS center
        FROM cls d JOIN (SELECT DISTINCT track_id, x, cluster, centre FROM cr) c ON c.track_id = d.track_id AND c.x = d.dt_ms / 1000.0::DOUBLE WHERE dt_ms > 0""", _WALK),
    "sampling_normalization": _events(_NORMAL, _WALK),
    "audit_metrics": _events(_METRICS, _RUNS + _WALK),
    "export_time_deltas": _events(_TIME_EXPORT),
    "motion_pairs": _events("SELECT track_id, from_index, to_index, pair_class, round(dt_sec, 6) AS dt_sec, round(dd_meters, 6) AS dd_meters, time_raw FROM mp", _MOTION),
    "motion_summary": _events(_MOTION_SUM, _MOTION),
    "motion_summary_orders": _of_orders(_MOTION_SUM, _MOTION),
    "motion_rejections": _events("SELECT track_id, from_index, to_index, pair_class, round(dt_sec, 6) AS dt_sec, round(dd_meters, 6) AS dd_meters, time_raw FROM mp WHERE pair_class <> 'forward'", _MOTION),
    "motion_medians": _events("""SELECT track_id, figure, count(*) AS n, round(median(x), 6) AS median FROM (SELECT track_id, 'dt_sec' AS figure, dt_sec AS x FROM mp WHERE pair_class = 'forward'
        UNION ALL SELECT track_id, 'mps', dd_meters / dt_sec FROM mp WHERE pair_class = 'forward') GROUP BY track_id, figure""", _MOTION),
    "local_block": f"""WITH {EVENT_SQL}{_PTS}, own AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM pts WHERE gpx_index BETWEEN {BLOCK[0]} AND {BLOCK[1]} WINDOW w AS (PARTITION BY track_id ORDER BY gpx_index)),
        g AS (SELECT track_id, sum({_m('a', 'b', 'lat', 'lon')}) AS m, count(*) AS n, arg_min(lat, gpx_index) AS y1, arg_min(lon, gpx_index) AS x1, arg_max(lat, gpx_index) AS y2, arg_max(lon, gpx_index) AS x2, arg_min(ROW(ts_ms), gpx_index)[1] AS t1, arg_max(ROW(ts_ms), gpx_index)[1] AS t2 FROM own GROUP BY track_id)
        SELECT track_id, round(coalesce(m, 0), 6) AS cumulative_m, round(CASE WHEN n > 1 THEN {_m('y1', 'x1', 'y2', 'x2')} ELSE 0 END, 6) AS displacement_m, coalesce(n, 0) AS points, round(CASE WHEN n > 1 THEN (t2 - t1) / 1000.0::DOUBLE END, 6) AS elapsed_sec FROM (SELECT DISTINCT track_id FROM pts) LEFT JOIN g USING (track_id)""",
    "route_bounds": f"WITH {EVENT_SQL}{_PTS} SELECT track_id, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts GROUP BY track_id",
    "point_neighbourhood": f"""WITH {EVENT_SQL}{_PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY gpx_index) AS pos FROM pts), c AS (SELECT track_id, pos AS c FROM p WHERE gpx_index = {CENTRE})
        SELECT track_id, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM p JOIN c USING (track_id) WHERE abs(pos - c) <= {REACH} GROUP BY track_id""",
    "nearest_point": f"""WITH {EVENT_SQL}{_PTS}, q AS (SELECT track_id, (min(lat) + max(lat)) / 2 AS y, (min(lon) + max(lon)) / 2 AS x FROM pts GROUP BY track_id),
        r AS (SELECT p.*, row_number() OVER (PARTITION BY track_id ORDER BY (lat - y) * (lat - y) + (lon - x) * (lon - x), gpx_index) AS n FROM pts p JOIN q USING (track_id)) SELECT track_id AS probe_id, track_id, gpx_index, lat, lon FROM r WHERE n = 1""",
    "bandwidth": _events("SELECT track_id, round(h, 6) AS h, n FROM s", _KDE),
    "kde_curve": _events(_CURVE, _KDE),
    "bandwidth_distance": _events("SELECT track_id, round(h, 6) AS h, n FROM s", _KDE_M),
    "kde_distance_curve": _events(_CURVE, _KDE_M),
    "kde_nearest_grid": _events(f"{_CURVE} QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY abs(kde.x_log - {CURSOR}), grid_i) = 1", _KDE),
    "density_overview": f"""WITH t AS ({_events(_OVERVIEW, _KDE)}), m AS ({_events(_OVERVIEW, _KDE_M)})
        SELECT track_id, t.h AS time_bandwidth, coalesce(t.peaks, 0) AS time_peaks, coalesce(m.h, 1) AS distance_bandwidth, coalesce(m.peaks, 0) AS distance_peaks FROM t FULL OUTER JOIN m USING (track_id)""",
    "chart_ticks": _events("""SELECT track_id, share, CASE WHEN share = 0 THEN '0' ELSE CASE WHEN share < 1 THEN '~' ELSE '' END || CASE WHEN m >= 1 THEN CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', m) END END || ' m' AS tick
        FROM (SELECT track_id, share, CASE share WHEN 1 THEN most ELSE exp(ln(1 + most) * share) - 1 END AS m
              FROM (SELECT track_id, max(dd_meters) AS most FROM joint GROUP BY track_id), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) AS t(share))""", _JOINT),
    "kde_peaks": _events(_PEAKS, _KDE),
    "kde_distance_peaks": _events(_PEAKS, _KDE_M),
    "bandwidth_range": _events("""SELECT track_id, round(low, 6) AS low, round(high, 6) AS high, round(greatest(1e-4, (high - low) / 1000), 6) AS step FROM
        (SELECT track_id, CASE WHEN h < a THEN greatest(1e-3, h * 0.5) ELSE a END AS low, CASE WHEN h > b THEN h * 2 ELSE b END AS high FROM
            (SELECT track_id, greatest(1e-3, (hi - lo) / 50) AS a, (hi - lo) / 5 AS b, h FROM s))""", _KDE),
    "chart_domains": _events("SELECT track_id, round(least(ln(1e-10), min(ln(greatest(1e-10, dt_sec)))), 6) AS min_dt_sec, round(max(ln(greatest(1e-10, dt_sec))), 6) AS max_dt_sec, round(least(ln(1e-10), min(ln(greatest(1e-10, dd_meters)))), 6) AS min_dd_meters, round(max(ln(greatest(1e-10, dd_meters))), 6) AS max_dd_meters FROM joint GROUP BY track_id", _JOINT),
    "chart_viewport": _events("SELECT track_id, from_index, to_index, round(dt_sec, 6) AS dt_sec, round(dd_meters, 6) AS dd_meters FROM joint WHERE ln(greatest(1e-10, dt_sec)) BETWEEN 8 AND 10.5 AND ln(greatest(1e-10, dd_meters)) BETWEEN 6 AND 7", _JOINT),
    "chart_sequence": _events("""SELECT track_id, CAST(pos AS INTEGER) AS pos, from_index, to_index, round(dt_sec, 6) AS dt_sec, round(dd_meters, 6) AS dd_meters, round(CASE WHEN most > 0 THEN least(1.0, greatest(0.0, ln(1 + dd_meters) / ln(1 + most))) ELSE 0 END, 6) AS shade FROM
        (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY to_index) - 1 AS pos, count(*) OVER (PARTITION BY track_id) AS n, max(dd_meters) OVER (PARTITION BY track_id) AS most FROM joint)
        WHERE pos < CASE WHEN n > 200 THEN 200 ELSE least(n, greatest(30, round(n * 0.7::DOUBLE))) END""", _JOINT),
    "chart_legend": _events("SELECT track_id, share, round(CASE share WHEN 1 THEN most ELSE exp(ln(1 + most) * share) - 1 END, 6) AS meters FROM (SELECT track_id, max(dd_meters) AS most FROM joint GROUP BY track_id), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) AS t(share)", _JOINT),
} | {f"temporal_blocks_{k}": _events(f"{_BLOCKS} AND kind = '{k}'", _RUNS) for k in KINDS}
_HELD = f"""SELECT track_id, description, key, kind || ' ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS expected, actual, coalesce(CASE kind WHEN 'eq' THEN actual = value ELSE actual >= value END, false) AS pass,
    CASE WHEN coalesce(CASE kind WHEN 'eq' THEN actual = value ELSE actual >= value END, false) THEN 'PASS' WHEN soft THEN 'EXPECTED_VARIANCE' ELSE 'FAIL' END AS status
    FROM (SELECT m.track_id, e.*, CASE key WHEN 'total_points' THEN total_points WHEN 'missing' THEN missing WHEN 'backtracking' THEN backtracking WHEN 'multiple_types' THEN 0 ELSE missing_longest END::DOUBLE AS actual
          FROM ({_METRICS}) m, (VALUES {", ".join(f"('{a}', '{b}', '{c}', {v}::DOUBLE, {soft})" for a, b, c, v, soft in EXPECTED)}) AS e(description, key, kind, value, soft))"""
ORACLE |= {
    "expected_figures": _events(_HELD, _RUNS + _WALK),
    "expected_statuses": _events(f"""SELECT track_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'EXPECTED_VARIANCE') THEN 'EXPECTED_VARIANCE' ELSE 'PASS' END AS status,
        count(*) AS checks, count(*) FILTER (NOT pass) AS failed FROM ({_HELD}) GROUP BY track_id""", _RUNS + _WALK),
}
ORACLE |= {"point_classes_segmented": ORACLE["point_classes"], "temporal_blocks_segmented": _events(_BLOCKS, _RUNS), "temporal_blocks_orders_segmented": ORACLE["temporal_blocks_orders"]}
ORACLE = {k: v.replace("FILTER (", "FILTER (WHERE ") for k, v in ORACLE.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
