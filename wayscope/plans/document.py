"""One versioned audit document per track."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finite
from ..operators import ingest, motion, sampling, temporal
from ..operators.classify import classify, usable_distance
from ..operators.clustering import cluster_counts
from ..schemas import KINDS, SCHEMA_VERSION

_EMPTY = "array<struct<gpxIndex:bigint,pointType:string,rawLat:string,rawLon:string,rawEle:string,rawTime:string,reason:string>>"


def ingestion_section(found: DataFrame, tracks: DataFrame) -> DataFrame:
    c = ingest.counts(found)
    event = F.struct(F.col("gpx_index").alias("gpxIndex"), F.col("point_type").alias("pointType"), F.col("raw_lat").alias("rawLat"), F.col("raw_lon").alias("rawLon"), F.col("raw_ele").alias("rawEle"), F.col("raw_time").alias("rawTime"), "reason")
    events = ingest.rejected(found).groupBy("track_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    s = tracks.select("track_id").join(c, "track_id", "left").join(events, "track_id", "left")
    n = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    b = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    counts = F.struct(n("total_points", "totalPointCount"), n("valid_points", "validPointCount"), n("rejected_points", "rejectedPointCount"), F.struct(n("wpt", "wpt"), n("rtept", "rtept"), n("trkpt", "trkpt")).alias("pointTypeCounts"))
    context = F.struct(b("has_multiple_point_types", "hasMultiplePointTypes"), b("has_any_timestamp_values", "hasAnyTimestampValues"))
    return s.select("track_id", F.struct(counts.alias("counts"), context.alias("context"), F.struct(F.coalesce("events", F.array().cast(_EMPTY)).alias("events")).alias("rejections")).alias("ingestion"))


#: Fields that are null, not 0, where a track has no valid points.
_NULL = {"rawSessionDurationSec", "maxDepthFromAnchorMs", "minMs", "maxMs", "medianMs", "normalization", "meanSpeedMps", "medianSpeedMps", "maxSpeedMps"}


def _blank(kind: T.DataType, name: str = "") -> Column:
    """What a section says of no points at all. Put together of literals: fields of a from_json are null once only some of them are asked for."""
    if name in _NULL:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(_blank(f.dataType, f.name).alias(f.name) for f in kind))
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(sampling.ALPHA if name == "insertionRelativeThreshold" else 0).cast(kind)


def _or_blank(frame: DataFrame, name: str) -> Column:
    return F.coalesce(name, _blank(frame.schema[name].dataType)).alias(name)


SECTIONS = ("ingestion", "temporal", "sampling", "motion")


def audit_documents(
    found: DataFrame, tracks: DataFrame | None = None, generated_at: str | None = None, zone: str = "UTC", sections: tuple[str, ...] = SECTIONS, point_counts: DataFrame | None = None
) -> DataFrame:
    """track_id, metadata, audit: a document per track.

    found: all points found; tracks (track_id, file_name): those that get a document even without any point, by default those of found.
    generated_at: text put into every document, null by default, so that results repeat. zone: of clock times. sections: those that are audited; the
    others are null. point_counts (track_id, total_points): what a document says that its track has, where that isn't null, instead of what the
    ingestion section counted; without either it says 0.
    """
    if set(sections) - set(SECTIONS):
        raise ValueError(f"no such section: {sorted(set(sections) - set(SECTIONS))}")
    tracks = found.select("track_id", "file_name").distinct() if tracks is None else tracks.select("track_id", "file_name")
    c = classify(ingest.points(found)).persist(StorageLevel.MEMORY_AND_DISK)  # read by three sections
    made = {"ingestion": ingestion_section(found, tracks), "temporal": temporal.section(c, zone), "sampling": sampling.section(c), "motion": motion.section(c)}
    doc = tracks.join(made["ingestion"], "track_id", "left")
    for name in SECTIONS[1:]:
        if name in sections:
            doc = doc.join(made[name], "track_id", "left")
    counted = F.coalesce("ingestion.counts.totalPointCount", F.lit(0)) if "ingestion" in sections else F.lit(0).cast("bigint")
    if point_counts is not None:
        told = point_counts.select("track_id", F.col("total_points").cast("bigint").alias("told_points"))
        doc, counted = doc.join(told, "track_id", "left"), F.coalesce("told_points", counted)
    metadata = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(generated_at).cast("string").alias("generatedAtUtc"), F.struct(F.col("file_name").alias("fileName")).alias("source"),
        F.struct(counted.alias("totalPointCount")).alias("summary"),
    )
    none = lambda name: F.lit(None).cast(made[name].schema[name].dataType).alias(name)
    own = [F.col("ingestion") if "ingestion" in sections else none("ingestion"), *(_or_blank(doc, x) if x in sections else none(x) for x in SECTIONS[1:])]
    return doc.select("track_id", metadata.alias("metadata"), F.struct(*own).alias("audit"))


def to_json_rows(documents: DataFrame) -> DataFrame:
    """track_id and the document as JSON text; null fields are kept, keys in the document's order."""
    return documents.select("track_id", F.to_json(F.struct("metadata", "audit"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    """A document per line."""
    to_json_rows(documents).select(F.col("json").alias("value")).write.text(path)


def delta_documents(deltas: DataFrame, name: str = "deltas") -> DataFrame:
    """track_id and JSON {name: [...], count: n} of a track's deltas or pairs, ordered by to_index."""
    fields = [c for c in deltas.columns if c not in ("track_id", "on_progress")]
    camel = {"from_index": "fromIndex", "to_index": "toIndex", "dt_sec": "dtSec", "dd_meters": "ddMeters"}
    item = F.struct(F.col("to_index").alias("k"), F.struct(*(F.col(c).alias(camel.get(c, c)) for c in fields)).alias("e"))
    listed = deltas.groupBy("track_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select("track_id", F.to_json(F.struct(F.transform("x", lambda v: v["e"]).alias(name), F.size("x").alias("count"))).alias("json"))


def metrics(documents: DataFrame) -> DataFrame:
    """The figures of a document that checks are made on, a column each."""
    t, s, m = "audit.temporal.temporalOrder", "audit.sampling", "audit.motion"
    paths = {
        "total_points": "audit.ingestion.counts.totalPointCount", "valid_points": "audit.ingestion.counts.validPointCount", "rejected_points": "audit.ingestion.counts.rejectedPointCount",
        "multiple_types": "audit.ingestion.context.hasMultiplePointTypes", "duration_sec": "audit.temporal.session.rawSessionDurationSec", "parseable": "audit.temporal.session.parseableTimestampPointCount",
        "forward": f"{t}.monotonicForwardCount", "missing": f"{t}.missing.pointCount", "unparsable": f"{t}.unparsable.pointCount", "duplicate": f"{t}.duplicate.pointCount", "backtracking": f"{t}.backtracking.pointCount",
        "missing_longest": f"{t}.missing.maxBlockLength", "unparsable_longest": f"{t}.unparsable.maxBlockLength", "duplicate_longest": f"{t}.duplicate.maxBlockLength", "max_depth_ms": f"{t}.backtracking.maxDepthFromAnchorMs",
        "positive_deltas": f"{s}.time.timestampContext.positiveTimeDeltaCount", "non_positive": f"{s}.time.timestampContext.rejections.nonPositiveTimeDeltaPairs.nonPositivePairCount",
        "sorted_clusters": f"{s}.time.clustering.sortedClusterCount", "sequential_clusters": f"{s}.time.clustering.sequentialClusterCount", "geometry_deltas": f"{s}.distance.geometryConditioned.deltaCount",
        "motion_pairs": f"{m}.evaluatedPairs.consecutivePairCount", "motion_forward": f"{m}.evaluatedPairs.forwardValidPairCount", "backward_pairs": f"{m}.rejections.backwardTimePairCount", "invalid_share": f"{m}.time.invalidTimeShareOfEvaluatedTime",
    }
    return documents.select("track_id", *(F.col(p).alias(k) for k, p in paths.items()))


def track_metrics(found: DataFrame) -> DataFrame:
    """The columns of metrics(), a row per track of found, counted from the points: no document, list or cluster is put together.

    Points are counted per run, then runs per track, on the partitioning that the windows of classify() left.
    """
    c = classify(ingest.points(found))
    timed, dt, paired = F.col("ts_ms").isNotNull(), F.col("dt_ms"), finite(F.col("anchor_m"))
    at = F.when(timed, F.col("gpx_index"))
    counts = {
        "parseable": timed, "positive_deltas": dt > 0, "non_positive": dt <= 0, "geometry_deltas": F.col("prev_index").isNotNull() & usable_distance(F.col("prev_m")), "motion_pairs": F.col("last").isNotNull(),
        "motion_forward": paired & (dt > 0), "backward_pairs": paired & (dt < 0),
    }
    runs = c.groupBy("track_id", "temporal_class", "run").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth_ms").alias("depth"), *(F.count_if(v).alias(k) for k, v in counts.items()), F.sum(F.when(paired & (dt > 0), dt)).alias("up"), F.sum(F.when(paired & (dt < 0), -dt)).alias("down"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by("ts_ms", at).alias("first_ms"), F.max_by("ts_ms", at).alias("last_ms"),
    )
    of = lambda k: F.col("temporal_class") == k
    tracks = runs.groupBy("track_id").agg(
        (F.max_by("last_ms", "last_at") - F.min_by("first_ms", "first_at")).alias("duration_ms"), F.max("depth").alias("max_depth_ms"), *(F.sum(k).alias(k) for k in counts), *(F.sum(F.when(of(k), F.col("n"))).alias(k) for k in ("forward", *KINDS)),
        *(F.max(F.when(of(k) & (F.col("n") > 1), F.col("n"))).alias(f"{k}_longest") for k in KINDS), F.sum("up").alias("up"), F.sum("down").alias("down"),
    )
    clusters = cluster_counts(sampling.time_deltas(c))
    every = ingest.counts(found).withColumnRenamed("has_multiple_point_types", "multiple_types").join(tracks, "track_id", "left").join(clusters, "track_id", "left")
    up, down = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    n = lambda *names: [F.coalesce(x, F.lit(0)).alias(x) for x in names]
    return every.select(
        "track_id", "total_points", "valid_points", "rejected_points", "multiple_types", (F.col("duration_ms") / 1000).alias("duration_sec"),
        *n("parseable", "forward", "missing", "unparsable", "duplicate", "backtracking", "missing_longest", "unparsable_longest", "duplicate_longest"), "max_depth_ms",
        *n("positive_deltas", "non_positive", "sorted_clusters", "sequential_clusters", "geometry_deltas", "motion_pairs", "motion_forward", "backward_pairs"),
        F.when(up + down > 0, down / (up + down)).otherwise(0.0).alias("invalid_share"),
    )
