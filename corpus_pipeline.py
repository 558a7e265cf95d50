"""The training corpus, stage by stage: each calls one operator of wayscope.llm on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads as
the next one's docs. All but the last return the columns of docs, whatever other columns there are. Every stage takes null, empty and very
long texts, null ids, repeated rows and empty tables; what becomes of them is stated at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayscope.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from wayscope.llm.queries import tokenizer
from wayscope.llm.scratch import collected, remove, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; examples to learn from are those that docs still holds. Null and empty texts score as such examples do; rows that repeat an id or a text are scored one by one."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text up to the case of A-Z, the one with the largest id stays; of rows that share that id too, one. Null and
    empty texts are equal: one document of them stays. A null id is smaller than any other."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id. Texts without words, null and empty ones among them, are
    classes by themselves; rows that share an id stay or go together."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target shares of the tokens. Texts without words go; null sources and
    languages count as ''; rows that share an id stay or go together."""
    return mixing.keep_sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; null and empty texts are the end token alone, rows are packed one by one."""
    return packing.pack(docs, tokenizer())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: Exact dedup and mixing are all that SQL expresses of the stages; tests hold the operators of the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted once its result is there, and that once the next one's is."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with collected() as made:
            docs = written(stage(spark, docs, sf_dir), "stage")
        for path in [*made[:-1], *([held] if held else [])]:  # the result is what was written last
            remove(spark, path)
        held = made[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
