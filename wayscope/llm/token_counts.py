"""Exact token statistics from a histogram of encoded lengths.

Documents are encoded once and only (length, number of documents) is kept; suffix sums over that table answer totals, quantiles and
truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .tokens import encoder
from .words import chunks

BAND = 1024


def lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and tokens of each row, over its whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                _, at = own.ids(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64())], ["doc_id", "tokens"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, tokens long")


def histogram(counted: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """length and n_docs; one row for each length that occurs, combined before the shuffle."""
    return counted.groupBy(F.col(tokens_col).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Of each length that occurs, with n_docs and n_tokens of exactly that length: docs_at_least, tokens_at_least (that length or more),
    tokens_truncated (all documents cut to that length) and share_at_most (of the documents; quantile q is the least length with q or more).

    Sums run within bands of lengths and over the bands' totals, so no task sorts the whole table. An empty table gives no rows.
    """
    hist = written(hist, "histogram")  # texts are encoded once
    per = hist.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "band": F.floor(F.col("length") / BAND)})
    whole = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = per.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    # One row for each BAND lengths: the longest document's length over BAND at most.
    above = bands.select("band", F.coalesce(F.sum("d").over(whole), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(whole), F.lit(0)).alias("tokens_above"))
    all_docs, all_tokens = bands.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    within = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(above, "band")
    docs, tokens = F.sum("n_docs").over(within) + F.col("docs_above"), F.sum("n_tokens").over(within) + F.col("tokens_above")
    return out.select("length", "n_docs", "n_tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least")).select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.lit(all_tokens) - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.lit(all_docs) - F.col("docs_at_least") + F.col("n_docs")) / F.lit(max(1, all_docs))).alias("share_at_most"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_docs_cut and tokens: all documents cut to each limit, whether or not a document has that length."""
    longer = [F.min_by(F.when(F.col("length") > x, F.struct("docs_at_least", "tokens_at_least")), F.when(F.col("length") > x, F.col("length"))).alias(f"x{i}") for i, x in enumerate(limits)]
    one = sums.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"), *longer)

    def answer(i: int, x: int):
        docs, tokens = F.coalesce(f"x{i}.docs_at_least", F.lit(0)), F.coalesce(f"x{i}.tokens_at_least", F.lit(0))
        return F.struct(F.lit(x).cast("long").alias("limit"), docs.alias("n_docs_cut"), (F.col("all_tokens") - tokens + docs * F.lit(x)).alias("tokens"))

    return one.select(F.explode(F.array(*(answer(i, x) for i, x in enumerate(limits)))).alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and length: the least length that this share of the documents, or more, don't exceed."""
    aggs = [F.min(F.when(F.col("share_at_most") >= q, F.col("length"))).alias(str(i)) for i, q in enumerate(shares)]
    return sums.agg(*aggs).select(F.explode(F.array(*(F.struct(F.lit(q).alias("share"), F.col(str(i)).alias("length")) for i, q in enumerate(shares)))).alias("x")).select("x.*")
