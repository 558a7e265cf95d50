"""Mixing sources to target weights by iterative proportional fitting.

Documents are reduced to the tokens of each cell (source, language, topic). Cells' weights are raked in turn to the target shares of the
sources, languages and topics, sweep by sweep; a cell never gets more than all its tokens, nor a language or topic more than nearly all of its own. A document is then sampled with its cell's
share of its tokens as probability, by a hash of its id, so that the same documents are sampled wherever and however often this runs.

DataFrame functions do all work on documents and cells. The driver holds one number per language and topic pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fresh, written

SWEEPS = 12
TEMPERATURE = 0.7  # default targets: shares in proportion to tokens to this power, which evens sources out
BUDGET = 0.7  # of all tokens
MOST_PAIRS = 100_000
ROUNDS, SLACK = 8, 0.98
SEED = 42
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def topic_of(text: Column) -> Column:
    """A plain topic of a whole text, by what stands out in it: table, numeric, marked, list, prose or none (no text)."""
    size = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "none").when(share("[|]") >= 0.02, "table").when(share("[0-9]") >= 0.05, "numeric")
        .when(share("[#$%&*!=<>{}@^~_]") >= 0.03, "marked").when(share("\\n") >= 0.0125, "list").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """In [0, 1), from 48 bits of a digest of the seed and the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)


def _shares(cells: DataFrame, key: str, temperature: float) -> DataFrame:
    """key and share, by default: tokens to the power of temperature. One row per value."""
    powers = cells.groupBy(key).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("power")).where("power > 0")
    total = powers.agg(F.sum("power")).first()[0] or 1.0
    return powers.select(key, (F.col("power") / F.lit(total)).alias("share"))


def fillable(shares: dict[str, float], room: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Shares of a sample, none above the room that its value's tokens leave; what is cut goes to the others in proportion. Where the others want
    nothing, or have no room either, the shares add up to less than 1; margins() tells what was reached."""
    cut = {k: room.get(k, 0.0) * SLACK for k in shares}
    for _ in range(rounds):
        full = {k for k in shares if shares[k] >= cut[k]}
        free = sum(v for k, v in shares.items() if k not in full)
        left = 1 - sum(cut[k] for k in full)
        shares = {k: cut[k] if k in full else v * left / free if free else 0.0 for k, v in shares.items()}
    return shares


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, their share of the sample, and probability = weight * budget tokens / tokens.

    targets: for source, lang and topic a table (that column, share). Values that a target lacks, and cells without tokens, get nothing.
    Sources may be many: their factors stay in the table. Languages times topics are MOST_PAIRS at most.
    """
    part = ["lang", "topic"]
    live = cells.join(targets["source"].select("source", F.col("share").alias("source_share")), "source").where("tokens > 0")
    live = written(live, "cells")
    pairs = {(r["lang"], r["topic"]): r["t"] for r in live.groupBy(*part).agg(F.sum("tokens").alias("t")).limit(MOST_PAIRS + 1).collect()}
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of a language and a topic")
    all_tokens = sum(pairs.values())
    room = {k: {} for k in part}
    for p, t in pairs.items():
        for i, k in enumerate(part):
            room[k][p[i]] = room[k].get(p[i], 0.0) + t / (budget * all_tokens)
    wanted = {k: dict(targets[k].limit(MOST_PAIRS + 1).collect()) for k in part}
    if any(len(v) > MOST_PAIRS for v in wanted.values()):
        raise ValueError(f"more than {MOST_PAIRS} targets of languages or topics")
    share = {k: fillable(wanted[k], room[k]) for k in part}
    factor = {p: float(share["lang"].get(p[0], 0) > 0 and share["topic"].get(p[1], 0) > 0) for p in pairs}
    spark = cells.sparkSession
    most = F.col("tokens") / F.lit(budget * max(1, all_tokens))

    def weighted() -> DataFrame:
        """After the sources' turn: a source's cells are as many as there are pairs."""
        table = F.broadcast(spark.createDataFrame([(*p, f) for p, f in factor.items()], "lang string, topic string, factor double"))
        raw = live.join(table, part).withColumn("raw", F.col("tokens") * F.col("factor"))
        total = F.sum("raw").over(Window.partitionBy("source"))
        return raw.withColumn("weight", F.when(total > 0, F.least(F.col("raw") * F.col("source_share") / total, most)).otherwise(0.0))

    for _ in range(sweeps if pairs else 0):
        got = {(r["lang"], r["topic"]): r["w"] for r in weighted().groupBy(*part).agg(F.sum("weight").alias("w")).collect()}
        for i, key in enumerate(part):
            have: dict[str, float] = {}
            for p, w in got.items():
                have[p[i]] = have.get(p[i], 0.0) + w
            for p in got:
                turn = share[key].get(p[i], 0.0) / have[p[i]] if have[p[i]] > 0 else 0.0
                got[p] *= turn
                factor[p] *= turn
        scale = sum(factor.values())
        if not scale or not math.isfinite(scale):
            break
        factor = {p: f / scale for p, f in factor.items()}
    if not pairs:
        return live.select("source", "lang", "topic", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    out = weighted()
    return out.select("source", "lang", "topic", "tokens", "weight", F.least(F.lit(1.0), F.col("weight") / most).alias("probability"))


def margins(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, target, reached (the share of all weight that rake() gave), error (reached - target) of every value that has a target or a
    cell. Targets that ask for more tokens than there are, in sum or of one value, show here."""
    out = []
    for k in ("source", "lang", "topic"):
        got = raked.groupBy(F.col(k).alias("value")).agg(F.sum("weight").alias("reached"))
        met = targets[k].select(F.col(k).alias("value"), F.col("share").cast("double").alias("target")).join(got, "value", "full_outer")
        none = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        out.append(met.select(F.lit(k).alias("dimension"), "value", none("target"), none("reached")).withColumn("error", F.col("reached") - F.col("target")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (six decimals) and kept of each row.

    Null sources and languages count as the value ''. Texts without words, null among them, have no tokens to weigh and are not kept. Rows
    that repeat an id are kept or not together. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    facts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"), tokens_of(text).alias("n_tokens"),
    )
    facts = written(facts, "facts")
    cells = written(facts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = targets or {k: _shares(cells, k, temperature) for k in ("source", "lang", "topic")}
    raked = written(rake(cells, targets, budget).select("source", "lang", "topic", F.round("probability", 6).alias("probability")), "raked")
    # A hot source's rows are split by AQE where the cells are too many to be broadcast.
    out = facts.join(raked, ["source", "lang", "topic"], "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", ((uniform(F.col("doc_id"), seed) < F.col("probability")) & (F.col("n_tokens") > 0)).alias("kept"))


def keep_sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are sampled, all columns as they were, whatever their names; the rules are those of sample()."""
    id_col = options.get("id_col", "doc_id")
    name = fresh("sampled", docs)
    kept = sample(docs, **options).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


_S = "nullif(length(text), 0)"
_CELL_SQL = f"""facts AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN {_S} IS NULL THEN 'none'
             WHEN length(regexp_replace(text, '[^|]', '', 'g'))::DOUBLE / {_S} >= 0.02 THEN 'table'
             WHEN length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / {_S} >= 0.05 THEN 'numeric'
             WHEN length(regexp_replace(text, '[^#$%&*!=<>{{}}@^~_]', '', 'g'))::DOUBLE / {_S} >= 0.03 THEN 'marked'
             WHEN (length(text) - length(replace(text, chr(10), '')))::DOUBLE / {_S} >= 0.0125 THEN 'list' ELSE 'prose' END AS topic,
        coalesce(length(trim(regexp_replace(regexp_replace(text, '[^ \\t\\n\\x0B\\f\\r]+', 'x', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))), 0)::BIGINT AS n_tokens FROM documents)"""


def oracle_sql(sweeps: int = SWEEPS, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """DuckDB SQL for sample() with default targets over documents: the same sweeps, one by one."""
    margins = "".join(
        f", by_{k} AS MATERIALIZED (SELECT {k}, p / sum(p) OVER () AS share FROM (SELECT {k}, pow(sum(tokens)::DOUBLE, {temperature}) AS p FROM cells GROUP BY {k} HAVING sum(tokens) > 0))"
        for k in ("source", "lang", "topic")
    )
    sql = f"WITH {_CELL_SQL}, cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM facts GROUP BY ALL){margins}, "
    for k in ("lang", "topic"):  # as in fillable()
        sql += f"{k}_0 AS MATERIALIZED (SELECT {k}, any_value(share) AS share, {SLACK} * sum(tokens) / ({budget} * (SELECT sum(tokens) FROM cells)) AS cut FROM by_{k} JOIN cells USING ({k}) GROUP BY {k}), "
        for i in range(ROUNDS):
            free, left = "sum(CASE WHEN share < cut THEN share END) OVER ()", "(1 - coalesce(sum(CASE WHEN share >= cut THEN cut END) OVER (), 0))"
            sql += f"{k}_{i + 1} AS MATERIALIZED (SELECT {k}, CASE WHEN share >= cut THEN cut ELSE share * {left} / {free} END AS share, cut FROM {k}_{i}), "
    sql += f"live AS MATERIALIZED (SELECT c.*, s.share AS ss, l.share AS ls, t.share AS ts, tokens / ({budget} * sum(tokens) OVER ()) AS most FROM cells c JOIN by_source s USING (source) JOIN lang_{ROUNDS} l USING (lang) JOIN topic_{ROUNDS} t USING (topic) WHERE tokens > 0)"
    sql += ", f0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS f FROM live)"
    weight = "least(f * tokens * ss / sum(f * tokens) OVER (PARTITION BY source), most)"
    for i in range(sweeps):
        sql += f", w{i} AS MATERIALIZED (SELECT *, {weight} AS w FROM f{i})"
        sql += f", l{i} AS MATERIALIZED (SELECT * REPLACE (w * ls / sum(w) OVER (PARTITION BY lang) AS w, f * ls / sum(w) OVER (PARTITION BY lang) AS f) FROM w{i})"
        sql += f", f{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (w) REPLACE (f * ts / sum(w) OVER (PARTITION BY topic) AS f) FROM l{i})"
    sql += f", raked AS (SELECT source, lang, topic, round(least(1.0, {weight} / most), 6) AS probability FROM f{sweeps})"
    u = f"(('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(16**12)})"
    return sql + f" SELECT doc_id, source, lang, topic, n_tokens, coalesce(probability, 0) AS probability, {u} < coalesce(probability, 0) AND n_tokens > 0 AS kept FROM facts LEFT JOIN raked USING (source, lang, topic)"
