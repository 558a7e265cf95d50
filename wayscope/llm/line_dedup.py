"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and go from every document.

Each line's sites are counted by a HyperLogLog sketch per line hash; sketches merge by aggregation. Lines whose estimate is near the
threshold get exact distinct counts. Lines travel as hashes; only positions come back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

MIN_SITES = 8
PRECISION = 12  # the estimate's standard error is 1.6 %
NEAR = 0.1  # six of those
BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site: Column | None = None, near: float = NEAR) -> DataFrame:
    """one, two (hashes) and sites of the lines that stand on min_sites or more sites; exact is true where sites were counted exactly."""
    site = F.coalesce((F.col("source") if site is None else site).cast("string"), F.lit(""))
    lines = docs.select(site.alias("site"), F.explode(_lines(F.col(text_col).cast("string"))).alias("line")).select("site", F.trim("line", F.lit(BLANK)).alias("line")).where("line <> ''")
    hashed = lines.select(F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), "line").alias("two"), "site")
    # Only a line with two sites or more needs a sketch. Few numbers per line are kept for this; they combine before the shuffle.
    spread = hashed.groupBy("one", "two").agg(F.hll_sketch_agg("site", F.lit(PRECISION)).alias("sketch"))
    told = spread.select("one", "two", F.hll_sketch_estimate("sketch").cast("double").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - near) - 0.5)
    sure = told.where(F.col("estimate") > min_sites * (1 + near) + 0.5).select("one", "two", F.round("estimate").cast("long").alias("sites"), F.lit(False).alias("exact"))
    unsure = told.where(F.col("estimate") <= min_sites * (1 + near) + 0.5).select("one", "two")
    # Distinct (line, site) first, combined before its shuffle: a line in a third of all rows meets the join with a row per site.
    counted = hashed.distinct().join(unsure, ["one", "two"], "left_semi").groupBy("one", "two").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(counted.select("one", "two", "sites", F.lit(True).alias("exact")))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site: Column | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept_text of each row.

    Lines are what newlines separate; blanks around them don't count, and blank lines are never boilerplate. Kept lines are joined by a
    newline as they were. A null text is one blank line; a null site is the site ''. Rows that share an id are treated by their own texts. An
    empty table gives no rows; other columns play no part.
    """
    bad = written(boilerplate(docs, min_sites, text_col, site).select("one", "two"), "boilerplate")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    placed = texts.select("doc_id", "same", F.posexplode(_lines(F.col("text"))).alias("at", "line")).select("doc_id", "same", "at", F.trim("line", F.lit(BLANK)).alias("line"))
    hits = placed.where("line <> ''").select("doc_id", "same", "at", F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), "line").alias("two")).join(bad, ["one", "two"], "left_semi")
    at = hits.groupBy("doc_id", "same").agg(F.sort_array(F.collect_set("at")).alias("at")).select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), "at")
    met = texts.join(at.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), "left").withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "lines": _lines(F.col("text"))})
    # The stretches between removed lines, so that a text of any number of lines is walked once.
    begin, end = F.concat(F.array(F.lit(0)), F.transform("at", lambda x: x + 1)), F.concat("at", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begin, end, lambda b, e: F.slice("lines", b + 1, F.greatest(e - b, F.lit(0)))))
    text = F.array_join(kept, "\n")
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("at").cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"), text.alias("kept_text"))


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    return f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
             t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
             b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(source, '')) >= {min_sites})
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM b)) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE k NOT IN (SELECT k FROM b)), '')) AS kept_sha256 FROM t GROUP BY doc_id"""
