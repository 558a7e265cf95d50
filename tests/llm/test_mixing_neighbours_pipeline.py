"""Mixing, nearest neighbours and the stages of the pipeline."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscope.llm import mixing, neighbours, scratch


def test_raking_meets_margins(spark):
    rng = np.random.default_rng(3)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1000, 90000))) for i in range(6) for j in range(3) for k in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    want = {"source": {f"s{i}": 1 / 6 for i in range(6)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {"t0": 0.4, "t1": 0.4, "t2": 0.2}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in want.items()}
    got = mixing.rake(df, targets, budget=0.2).toPandas()
    for k, shares in want.items():
        assert all(abs(got.groupby(k).weight.sum()[x] - s) < 1e-6 for x, s in shares.items())
    total = sum(c[3] for c in cells)
    assert np.allclose(got.probability, got.weight * 0.2 * total / got.tokens) and got.probability.max() <= 1


def test_sample(docs, rows):
    got = {r.doc_id: r for r in mixing.sample(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        u = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:12], 16) / 16**12
        n = len((t or "").encode().split())
        assert got[i].n_tokens == n and got[i].kept == (u < got[i].probability and n > 0)
    kept = mixing.keep_sampled(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert mixing.sample(docs.limit(0)).count() == 0
    nothing = docs.where("text is null or trim(text) = ''")
    assert not any(r.kept for r in mixing.sample(nothing).collect())


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    x[1000:2000] = x[7]  # a third are one vector
    x /= np.linalg.norm(x, axis=1, keepdims=True) / rng.uniform(0.5, 2, (3000, 1))
    x = x.astype(np.float32).astype(float)
    x[1000:2000] = x[1000]
    ids = rng.permutation(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (None, x[0].tolist()), (9060, [1.0, None]), (9080, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.nearest(d, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    true = dict(zip(ids, x, strict=True))
    assert all(abs(s - float((true[i] * true[q]).sum())) < 1e-12 for q in got for i, s in got[q])
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and len(got[q]) == 20


def test_many_lists(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = brute(np.arange(4000), x)
    got = neighbours.nearest(d, lambda c: c % 20 == 0, lists=40).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    assert sum(len(set(r.v) & {i for i, _ in want[r.query_id]}) for r in got) / (20 * len(want)) >= 0.9


def test_ratio_decides_among_hundreds_of_lists(spark):
    rng = np.random.default_rng(11)
    x, ratio = rng.normal(size=(4000, 32)), 1.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = neighbours._units(x, 1.0)
    index = neighbours.Centroids(neighbours.balanced_centroids(unit, 400), 1.0)
    exact = neighbours._distances(unit[:100], index.points)
    inside = exact <= exact.min(axis=1, keepdims=True) * ratio
    assert np.median(inside.sum(axis=1)) > 64
    found, d, opens = index.within(unit[:100], ratio, 64, np.full(400, 10), 63)
    own = [set(f[e <= e[0] * ratio]) & set(np.flatnonzero(i)) for f, e, i in zip(found, d, inside, strict=True)]
    assert sum(map(len, own)) / inside.sum() > 0.99
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = brute(np.arange(4000), x)
    got = neighbours.nearest(frame, lambda c: c % 20 == 0, open_ratio=ratio, lists=400).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    assert sum(len(set(r.v) & {i for i, _ in want[r.query_id]}) for r in got) / (20 * len(want)) >= 0.9


def test_fitted_ratio_reaches_recall_with_part_of_the_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 12)) + 2 * rng.normal(size=(60, 12))[rng.integers(0, 60, 6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = neighbours._units(x, 1.0)
    centre = neighbours.balanced_centroids(unit, 155)
    ratio, width = neighbours.fitted_ratio(unit, centre, 20)
    d = neighbours._distances(unit, centre)
    share = (np.bincount(d.argmin(axis=1), minlength=155) * (d[::20] <= d[::20].min(axis=1, keepdims=True) * ratio)).sum(axis=1).mean() / 6000
    assert share < 0.2 and width < 60
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = brute(np.arange(6000), x)
    got = neighbours.nearest(frame, lambda c: c % 20 == 0, block=300).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    assert all(len(r.v) == 20 for r in got) and len(got) == 300
    assert sum(len(set(r.v) & {i for i, _ in want[r.query_id]}) for r in got) / (20 * len(want)) >= 0.93


def test_repeated_vectors_and_columns_with_any_name(spark):
    d = spark.createDataFrame([(i % 30, [1.0, float(i % 30)], 1, 2, 3) for i in range(300)], "vec_id long, embedding array<double>, id int, list int, shelf int")
    got = neighbours.nearest(d, lambda c: c % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, i + 1, i + 1) for i in range(5)] + [(20, i + 1, 29 - i) for i in range(5)]


def test_few_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(d, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert neighbours.nearest(d.limit(0), lambda c: c % 20 == 0).count() == 0


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 9)) for i in range(1, 26)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline(spark, docs, folder):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    left, seen = docs, None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, folder)
        assert out.columns == docs.columns
        seen = out.count()
        assert 0 < seen <= left.count()
        left = out.cache()
    at = Path(scratch.folder(spark).removeprefix("file://"))
    before = {p.name for p in at.iterdir()}
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == seen
    # Of the stages before the last one, only what the last one reads is left.
    names = sorted({p.name.rsplit("-", 1)[0] for p in at.iterdir() if p.name not in before})
    assert names.count("stage") == 1 and not {"digests", "known", "signed", "heads", "facts", "cells", "raked", "index", "near"} & set(names), names
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_on_columns_of_any_name_and_empty_tables(spark, docs, folder, tmp_path):
    import corpus_pipeline

    more = docs.select("*", *(F.lit(1).alias(c) for c in ("gone", "_kept", "sampled", "_digest", "_id", "at", "one", "same")))
    for rows, at in ((more, tmp_path / "more"), (more.limit(0), tmp_path / "none")):
        rows.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:3:2] + corpus_pipeline.STAGES[1:4:2]:
        out = stage(spark, more, str(tmp_path / "more"))
        assert out.columns == more.columns and out.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)


def test_targets_that_cannot_be_met_are_reported(spark):
    """A target of 0 beside one that fills up, and targets above what there is, give a sample and say what was reached."""
    d = spark.createDataFrame([(i, " ".join(["w"] * 10), "en" if i < 30 else "de", f"s{i % 2}") for i in range(100)], "doc_id long, text string, lang string, source string")
    share = lambda k, **v: spark.createDataFrame(list(v.items()), f"{k} string, share double")
    targets = {"source": share("source", s0=0.5, s1=0.5), "lang": share("lang", en=1.0, de=0.0), "topic": share("topic", prose=1.0)}
    assert mixing.fillable({"en": 1.0, "de": 0.0}, {"en": 0.4, "de": 1.0}) == {"en": 0.4 * mixing.SLACK, "de": 0.0}
    assert {r.lang for r in mixing.sample(d, targets).where("kept").collect()} == {"en"}
    cells = d.groupBy("source", "lang").agg(F.lit(300).cast("long").alias("tokens")).withColumn("topic", F.lit("prose"))
    told = {(r.dimension, r.value): r for r in mixing.margins(mixing.rake(cells, targets), targets).collect()}
    assert told["lang", "de"].reached == 0 and told["lang", "en"].error < -0.2 and abs(told["source", "s0"].reached - told["source", "s1"].reached) < 1e-6
    fine = targets | {"lang": share("lang", en=0.5, de=0.5)}
    assert all(abs(r.error) < 0.01 for r in mixing.margins(mixing.rake(cells, fine), fine).collect())
