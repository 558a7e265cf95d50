"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are grams of six bytes of the text with A-Z lower-cased and everything but letters and digits as one kind of gap, so that they reach
over a word's ends and catch inflected and compound words. The vocabulary is every gram of a bounded sample of distinct labelled texts whose
log-likelihood ratio says that it marks toxic ones, beyond what the number of grams tried gives by chance: that test decides, no number of
terms. Cosines over all words find toxic texts far worse, and terms of clean texts add little for four times the work (README). Document frequencies are counted over all documents.
Each document's nearest examples vote, weighted by cosine; votes are calibrated on the examples themselves, each scored without its own vote.
The index has posting lists in blocks of examples, and for each term the largest weight per block where it occurs: blocks whose bound can't
reach the k-th best cosine are skipped, which changes no result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks, text_bytes, worker_object

EXAMPLES = 8000  # distinct labelled texts that are learned from, at most
LEAST_DOCS = 4  # examples that a term occurs in
SURE = 1.5  # times the log of the grams tried: the least log-likelihood ratio of a term
NEAREST = 25
BLOCK = 64
FIRST = 8  # blocks that set the bound for the others
THRESHOLD = 0.3
EVIDENCE = 3
GRAM = 6
_FOLD = np.full(256, 32, np.uint8)
for _c in (*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)):
    _FOLD[_c] = _c
_FOLD[65:91] = np.arange(97, 123, dtype=np.uint8)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each place in the texts, in order: its row, and the gram that starts there; a gap stands before and after each text."""
    raw, at = text_bytes(texts)
    size = np.diff(at)
    padded = np.full(len(raw) + 2 * len(size), 32, np.uint8)
    row = np.repeat(np.arange(len(size)), size + 2)
    padded[np.arange(len(raw)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = _FOLD[raw]
    wide = padded.astype(np.uint64)
    n = len(padded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | wide[i : i + n]
    inside = row[:n] == row[GRAM - 1 :]
    return row[:n][inside], code[inside]


class Vocabulary:
    """Sorted codes of the terms; counts() finds them in texts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self._slot(codes)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, term and how often, sorted by row and term."""
        row, code = _grams(texts)
        if not len(self.codes) or not len(code):
            return (np.zeros(0, np.int64),) * 3
        hit = np.flatnonzero(self.maybe[self._slot(code)])
        row, code = row[hit], code[hit]
        term = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        good = self.codes[term] == code
        key, count = np.unique(row[good] * len(self.codes) + term[good], return_counts=True)
        return key // len(self.codes), key % len(self.codes), count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at start, one range after another."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)


class Index:
    """Unit vectors of the examples that have terms, as posting lists in blocks of examples; nearest() is exact."""

    def __init__(self, idf: np.ndarray, doc: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.idf, self.size = idf, len(doc)
        weight = self.unit(row, term, count, len(doc))
        heaviest = np.zeros(len(doc), np.int64)
        order = np.lexsort((weight, row))
        heaviest[row[order]] = term[order]  # the last, so the heaviest
        order = np.lexsort((doc, toxic, heaviest))  # alike examples share blocks, which keeps bounds low
        self.doc, self.toxic = doc[order], toxic[order].astype(np.float64)
        self.place = np.empty(len(doc), np.int64)
        self.place[order] = np.arange(len(doc))
        at = self.place[row]
        order = np.lexsort((at, term))
        self.at, self.weight, term = at[order], weight[order], term[order]  # posting lists, term by term
        blocks = self.at // BLOCK
        self.run = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(blocks) != 0)))) if len(term) else np.zeros(0, np.int64)
        self.run_size = np.diff(np.concatenate((self.run, [len(term)])))  # a run is what a term has in one block
        self.block, self.most = blocks[self.run], np.maximum.reduceat(self.weight, self.run) if len(term) else np.zeros(0)
        self.of_term = np.searchsorted(term[self.run], np.arange(len(idf) + 1))
        self.blocks = -(-len(doc) // BLOCK)

    def unit(self, row, term, count, rows: int) -> np.ndarray:
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight * weight, rows))
        return weight / np.maximum(norm[row], 1e-300)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, nearest first, ties by place."""
        size = self.of_term[term + 1] - self.of_term[term]
        runs, asked = _ranges(self.of_term[term], size), np.repeat(weight, size)
        bound = np.bincount(self.block[runs], asked * self.most[runs], self.blocks)
        first = np.argsort(-bound, kind="stable")[:FIRST]
        least, found = 0.0, []
        for turn in range(2):  # the likeliest blocks, then all others whose bound reaches the k-th best of those
            take = (bound > 0) & (bound >= least - 1e-12)
            other = np.ones(self.blocks, bool)
            other[first] = False
            take &= other if turn else ~other
            own = take[self.block[runs]]
            post = _ranges(self.run[runs[own]], self.run_size[runs[own]])
            near = np.bincount(self.at[post], np.repeat(asked[own], self.run_size[runs[own]]) * self.weight[post], self.size)
            at = np.flatnonzero(near > 0)
            at = at[at != without]
            found.append((at, near[at]))
            if len(at) >= k and not turn:
                least = np.partition(near[at], len(at) - k)[len(at) - k]
        at, cos = (np.concatenate(x) for x in zip(*found, strict=True))
        top = np.lexsort((at, -cos))[:k]
        return at[top], cos[top]

    def vote(self, at: np.ndarray, cos: np.ndarray, prior: float) -> float:
        return float((cos @ self.toxic[at] + 0.5 * prior) / (cos.sum() + 0.5))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function that fits best: pooled neighbours' mean x and y."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([1.0, a, b])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            n, sx, sy = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + sx, pools[-1][2] + sy]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 1] / p[:, 0], p[:, 2] / p[:, 0]


class Model:
    def __init__(self, vocabulary: Vocabulary, index: Index, prior: float, blank: float, points: tuple[np.ndarray, np.ndarray], alone: dict[bytes, int]):
        self.vocabulary, self.index, self.prior, self.blank, self.points, self.alone = vocabulary, index, prior, blank, points, alone

    def calibrated(self, vote: float) -> float:
        """A little of the vote itself keeps the order of what the steps make equal."""
        x, y = self.points
        return vote if not len(x) else float(0.95 * np.interp(vote, x, y) + 0.05 * vote)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_NOTHING = hashlib.blake2b(b"", digest_size=16).digest()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and a digest of the text as terms see it: copies have the same one."""
    for batch in batches:
        for part in chunks(batch, "text"):
            raw, at = text_bytes(part.column("text"))
            fold = _FOLD[raw].tobytes()
            same = [hashlib.blake2b(fold[s:e], digest_size=16).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(same, pa.binary())], ["doc_id", "same"])


def _chosen(same: dict[int, tuple[bytes, int]]):
    """Of the chosen ids' rows those with the chosen text, with its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [x.column("same").to_pylist() for x in _folded(iter([part]))]
                ids = part.column("doc_id").to_pylist()
                good = [i for i, x in enumerate(x for xs in found for x in xs) if same[ids[i]][0] == x]
                part = part.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([same[ids[i]][1] for i in good], pa.int32())], ["doc_id", "text", "toxic"])

    return run


def _term_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            row, code = _grams(part.column("text"))
            order = np.lexsort((row, code))
            row, code = row[order], code[order]
            new = np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[row[new]]
            code, at = np.unique(code[new], return_index=True)
            if len(code):
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.add.reduceat(toxic, at).astype(np.int64)), pa.array(np.add.reduceat(1 - toxic, at).astype(np.int64))], ["code", "toxic", "clean"])


def _count_terms(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary.codes), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                df += np.bincount(vocabulary.counts(part.column("text"))[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


def _example_terms(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, term, count = vocabulary.counts(part.column("text"))
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int64))) for x in (term, count))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])

    return run


def _apart(toxic: int, clean: int):
    """Log-likelihood ratio of a term's occurring in a of the toxic and b of the clean examples, against chance."""
    a, b, k, m = F.col("a").cast("double"), F.col("b").cast("double"), F.lit(float(toxic)), F.lit(float(clean))
    share = (a + b) / (k + m)
    part = lambda x, of: F.when(x > 0, x * F.ln(x / of)).otherwise(0.0)
    return 2 * (part(a, k * share) + part(b, m * share) + part(k - a, k * (1 - share)) + part(m - b, m * (1 - share)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """labels: doc_id, toxic (0, 1; null and other values don't count; of several the largest does). Only rows not held out are learned from,
    and each of their texts once, however many copies (A-Z lower-cased, other signs as gaps) have labels; of a text's labels the largest counts."""
    texts = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").try_cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    alike = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).mapInArrow(_folded, "doc_id long, same binary").join(known, "doc_id")
    alike = alike.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    # Of an id with several texts one is learned from. Bounded by examples, so it may go to all; texts of other documents go no further than the scan.
    alike = alike.groupBy("doc_id").agg(F.min_by(F.struct("same", "toxic"), "same").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    chosen = {r["doc_id"]: (bytes(r["x"]["same"]), r["x"]["toxic"]) for r in alike.collect()}
    ids = F.broadcast(texts.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long"))
    own = texts.join(ids, "doc_id").mapInArrow(_chosen(chosen), "doc_id long, text string, toxic int")
    own = written(own.groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).select("doc_id", "text", "toxic"), "examples")
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    prior = (toxic + 0.1) / (toxic + clean + 1)
    stats = own.mapInArrow(_term_stats, "code long, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    stats = written(stats.where(F.col("a") + F.col("b") >= LEAST_DOCS), "terms")
    marks = F.col("a") / max(1, toxic) > F.col("b") / max(1, clean)
    best = stats.where(marks & (_apart(toxic, clean) >= SURE * math.log(max(2, stats.count())))).select("code").collect()
    vocabulary = Vocabulary(np.sort(np.array([r["code"] for r in best], np.int64).view(np.uint64)))
    df, total = np.zeros(len(best)), 0
    for r in texts.mapInArrow(_count_terms(vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms rows at most
        df[r["term"]] = r["df"]
    total = texts.count()
    idf = np.log((total + 1) / (df + 1)) + 1
    rows = sorted(own.mapInArrow(_example_terms(vocabulary), "doc_id long, toxic int, terms array<long>, counts array<long>").collect(), key=lambda r: (r["doc_id"], r["terms"], r["counts"]))
    blank = [r["toxic"] for r in rows if not r["terms"]]
    # Copies of a toxic example without terms have none to be found by.
    alone = {chosen[r["doc_id"]][0]: r["doc_id"] for r in rows if r["toxic"] and not r["terms"] and chosen[r["doc_id"]][0] != _NOTHING}
    rows = [r for r in rows if r["terms"]]
    row = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    term, count = (np.array([x for r in rows for x in r[c]], np.int64) for c in ("terms", "counts"))
    label = np.array([r["toxic"] for r in rows], np.int64)
    index = Index(idf, np.array([r["doc_id"] for r in rows], np.int64), label, row, term, count)
    votes = own.repartition(own.sparkSession.sparkContext.defaultParallelism, "doc_id").mapInArrow(_votes(vocabulary, index, prior), "doc_id long, vote double, toxic int").orderBy("vote", "doc_id").collect()
    points = isotonic(np.array([r["vote"] for r in votes]), np.array([float(r["toxic"]) for r in votes])) if votes else (np.zeros(0), np.zeros(0))
    return Model(vocabulary, index, prior, (sum(blank) + prior) / (len(blank) + 1), points, alone)


def _votes(vocabulary: Vocabulary, index: Index, prior: float):
    """The vote on each example that has terms, without its own; a row per example at most."""
    own = {doc: place for place, doc in enumerate(index.doc.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, term, count = vocabulary.counts(part.column("text"))
                weight, edge = index.unit(row, term, count, part.num_rows), np.searchsorted(row, np.arange(part.num_rows + 1))
                some, ids = np.flatnonzero(np.diff(edge)), part.column("doc_id").to_pylist()
                votes = [index.vote(*index.nearest(term[edge[d] : edge[d + 1]], weight[edge[d] : edge[d + 1]], NEAREST, own[ids[d]]), prior) for d in some.tolist()]
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), pa.array(votes, pa.float64()), part.column("toxic").take(at)], ["doc_id", "vote", "toxic"])

    return run


def _scored(model: Model):
    of_evidence = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index
        worker_object()
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                row, term, count = model.vocabulary.counts(part.column("text"))
                weight, edge = index.unit(row, term, count, n), np.searchsorted(row, np.arange(n + 1))
                score, evidence = np.full(n, model.blank), [[] for _ in range(n)]
                none = pa.array(np.flatnonzero(np.diff(edge) == 0))
                for x in _folded(iter([pa.RecordBatch.from_arrays([none, part.column("text").take(none)], ["doc_id", "text"])])) if model.alone else ():
                    for d, same in zip(x.column("doc_id").to_pylist(), x.column("same").to_pylist(), strict=True):
                        if same in model.alone:
                            score[d] = model.calibrated(float((1 + 0.5 * model.prior) / 1.5))
                            evidence[d] = [{"doc_id": model.alone[same], "toxic": 1, "similarity": 1.0}]
                for d in np.flatnonzero(np.diff(edge)):
                    s, e = edge[d], edge[d + 1]
                    at, cos = index.nearest(term[s:e], weight[s:e], NEAREST)
                    score[d] = model.calibrated(index.vote(at, cos, model.prior))
                    evidence[d] = [{"doc_id": int(index.doc[i]), "toxic": int(index.toxic[i]), "similarity": round(float(c), 6)} for i, c in zip(at[:EVIDENCE], cos[:EVIDENCE], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(score, 0, 1)), pa.array(evidence, pa.list_(of_evidence))], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples) of each row, over its whole text.

    Texts without any term, empty ones and null among them, have the share of toxic ones among such examples; copies of a toxic one among those
    have its vote. Without labels all scores are the prior, 0.1. Rows that repeat an id or a text are scored one by one. Ids that aren't whole
    numbers are null; a null id is not held out. An empty table gives no rows; other columns play no part.
    """
    model = fit(docs, labels, id_col, text_col)
    texts = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_scored(model), "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,similarity:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns as they were; one pass after the model is fitted, no shuffle."""
    model = fit(docs, labels, id_col, text_col)
    inner = _scored(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col).cast(pa.string())], ["doc_id", "text"])
            keep = np.concatenate([x.column("score").to_numpy() < THRESHOLD for x in inner(iter([own]))])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
