"""Approximate nearest neighbours by largest inner product over balanced posting lists.

Vectors get one more component that makes all their norms equal, so that the largest inner product is the smallest distance.
Centroids, 2 sqrt(n) of them, come from a bounded sample, by k-means whose assignment is charged for a list's size. They form a graph in
memory, searched best-first. A vector is filed under its nearest centroid and, at a boundary, under further ones whose distance is nearly as
small. A query opens all lists whose distance is within a ratio of the nearest one's, and as many as it takes to hold k others. The ratio is
the least one that reaches a share of true neighbours within the sample. Every vector is indexed, and lists are searched whole: in blocks of
bounded size, against blocks of queries, so that a list of copies of one vector spreads over tasks; small lists that lie close share a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, workspace, written

SAMPLE = 20_000  # vectors that centroids are fitted on, or PER_CENTROID for each list if that is more
PER_CENTROID = 4
PROBES = 400  # vectors of the sample that the ratio is fitted on
RECALL = 0.93  # of their true neighbours, that lists within the ratio must hold
MOST_LISTS = 16_384  # sent with the tasks: 8 MB at 64 components
COPIES, COPY_RATIO = 2, 1.005  # lists that a vector may be in, and how much farther than the nearest they may lie
BLOCK = 4096  # vectors, and queries, that one task compares at a time
DEGREE = 24
AT_ONCE = 8  # of the nearest centroids not yet walked from, so many are taken in a step
CELLS = 1 << 21  # of a table of distances to centroids that is held at a time


def _units(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(0, most * most - (x * x).sum(axis=1, keepdims=True)))))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T))


def _parts(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, columns))
    return (slice(i, i + step) for i in range(0, rows, step))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means whose squared distances are raised in proportion to how far a list is over its share."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), lists, replace=False)].copy()
    charge = np.zeros(lists)
    for _ in range(rounds):
        own, least = np.empty(len(x), np.int64), np.empty(len(x))
        for part in _parts(len(x), lists):
            d = _distances(x[part], centre) ** 2
            own[part], least[part] = (d + charge).argmin(axis=1), d.min(axis=1)
        size = np.bincount(own, minlength=lists)
        charge = 0.5 * charge + 0.1 * least.mean() * (size * lists / len(x) - 1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
        empty = np.flatnonzero(size == 0)
        centre[empty] = x[rng.choice(len(x), len(empty))]
    return centre


def filed_under(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of x the nearest centroids, COPIES at most, and which of them it is filed under."""
    d = _distances(x, centre)
    n = min(COPIES, len(centre))
    near = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    own = np.take_along_axis(d, near, axis=1)
    return near, own <= np.maximum(own.min(axis=1, keepdims=True) * COPY_RATIO, 1e-9)


def fitted_ratio(x: np.ndarray, centre: np.ndarray, k: int, recall: float = RECALL, seed: int = 5) -> tuple[float, int]:
    """The least ratio within which lists hold that share of the probes' k nearest in x; and how many lists that opens for most probes."""
    probes = np.random.default_rng(seed).choice(len(x), min(PROBES, len(x)), replace=False)
    near, filed = (np.concatenate(v) for v in zip(*(filed_under(x[part], centre) for part in _parts(len(x), len(centre))), strict=True))
    need, opened = [], []
    for part in _parts(len(probes), len(x)):
        d = _distances(x[probes[part]], x)
        d[np.arange(len(d)), probes[part]] = np.inf
        true = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        to = _distances(x[probes[part]], centre)
        to /= np.maximum(to.min(axis=1, keepdims=True), 1e-9)
        need.append(np.where(filed[true], to[np.arange(len(to))[:, None, None], near[true]], np.inf).min(axis=2).ravel())
        opened.append(to)
    need = np.concatenate(need)
    ratio = max(1.0, float(np.quantile(need, recall, method="higher"))) if len(need) else 1.0
    return ratio, int(np.quantile((np.concatenate(opened) <= ratio).sum(axis=1), 0.9)) + 1


def _both_ways(near: np.ndarray) -> np.ndarray:
    """Each point's neighbours, then points that it is a neighbour of, as many again: those first that few others lead to."""
    n, degree = near.shape
    if not degree:
        return near
    source, target = np.repeat(np.arange(n), degree), near.ravel()
    order = np.lexsort((np.bincount(target, minlength=n)[source], target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.repeat(np.arange(n)[:, None], degree, axis=1)
    back[target[rank < degree], rank[rank < degree]] = source[rank < degree]
    return np.hstack((near, back))


class Centroids:
    """Centroids with their neighbourhood graph; search() walks it best-first for many vectors at a time."""

    def __init__(self, points: np.ndarray, most: float):
        self.points, self.most = points, most
        n = min(len(points), DEGREE + 1)
        near = []
        for part in _parts(len(points), len(points)):
            d = _distances(points[part], points)
            some = np.argpartition(d, n - 1, axis=1)[:, :n]
            near.append(np.take_along_axis(some, np.take_along_axis(d, some, axis=1).argsort(axis=1), axis=1)[:, 1:])
        self.next = _both_ways(np.concatenate(near))
        rng = np.random.default_rng(3)
        self.start = np.sort(rng.choice(len(points), min(len(points), 2 + int(len(points) ** 0.5)), replace=False))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids found and their distances, nearest first; rows that found fewer end with infinite ones."""
        n, c = len(x), len(self.points)
        width = min(width, c)
        dist, done, rows = np.full((n, c), np.inf), np.zeros((n, c), bool), np.arange(n)
        dist[:, self.start] = _distances(x, self.points[self.start])
        live = rows
        some = min(AT_ONCE, c)
        while len(live):
            open_ = np.where(done[live], np.inf, dist[live])
            best = np.argpartition(open_, some - 1, axis=1)[:, :some]
            worst = np.partition(dist[live], width - 1, axis=1)[:, width - 1]
            nearest = np.take_along_axis(open_, best, axis=1)
            row, at = np.nonzero(np.isfinite(nearest) & (nearest <= worst[:, None]))
            walked, node = live[row], best[row, at]
            done[walked, node] = True
            if self.next.size and len(walked):
                to = self.next[node]
                new = ~np.isfinite(dist[walked[:, None], to])
                q, to = np.repeat(walked, new.sum(axis=1)), to[new]
                dist[q, to] = np.sqrt(((self.points[to] - x[q]) ** 2).sum(axis=1))
            live = live[np.unique(row)]
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return order, np.take_along_axis(dist, order, axis=1)

    def within(self, x: np.ndarray, ratio: float, width: int, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As search(), and which of the found a row opens: those within the ratio, and the nearest ones until they hold that many vectors. The
        width grows for each row until the farthest centroid found is not to be opened, or all are found."""
        width = min(max(8, width), len(self.points))
        found, d = self.search(x, width)
        while True:
            held = np.cumsum(sizes[found] * np.isfinite(d), axis=1)
            opens = np.isfinite(d) & ((d <= np.maximum(d[:, :1] * ratio, 1e-9)) | (held - sizes[found] < least))
            more = np.flatnonzero(opens[:, -1])
            if width == len(self.points) or not len(more):
                return found, d, opens
            new = min(2 * width, len(self.points))
            found = np.pad(found, ((0, 0), (0, new - width)))
            d = np.pad(d, ((0, 0), (0, new - width)), constant_values=np.inf)
            found[more], d[more] = self.search(x[more], new)
            width = new


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _file(lists: Centroids, size: int):
    """Rows (list, id, vector): each vector under its nearest list, and under the next ones whose distance is nearly as small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _parts(batch.num_rows, len(lists.points)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                near, filed = filed_under(_units(_matrix(part.column("vector"), size), lists.most), lists.points)
                row, rank = np.nonzero(filed)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, rank].astype(np.int32)), part.column("id").take(pa.array(row)), part.column("vector").take(pa.array(row))], ["list", "id", "vector"])

    return run


def _open(lists: Centroids, size: int, ratio: float, width: int, counts: np.ndarray, least: int, shelf: np.ndarray):
    """Rows (shelf, id, vector, lists): for each query and shelf the lists there that it opens. Any length of a query gives the same order of
    vectors; the one that stored vectors have makes distances comparable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _parts(batch.num_rows, 4 * len(lists.points)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                x = _matrix(part.column("vector"), size)
                x = np.hstack((x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * lists.most, np.zeros((len(x), 1))))
                found, _, opens = lists.within(x, ratio, width, counts, least)
                row, rank = np.nonzero(opens & (shelf[found] >= 0))
                own = found[row, rank]
                order = np.lexsort((own, shelf[own], row))
                row, own = row[order], own[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(shelf[own]) != 0)))) if len(row) else np.zeros(0, np.int64)
                edge = pa.array(np.concatenate((new, [len(row)])).astype(np.int32))
                at = pa.array(row[new])
                opened = pa.ListArray.from_arrays(edge, pa.array(own.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(shelf[own[new]].astype(np.int32)), part.column("id").take(at), part.column("vector").take(at), opened], ["shelf", "id", "vector", "lists"])

    return run


def _best(k: int):
    """Of one block of a shelf and one block of queries: each query's k best among the lists it opens."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(vectors):
            q, x = (np.stack(t.vector.to_numpy()).astype(np.float64) for t in (queries, vectors))
            ids, asks, opened = vectors.id.to_numpy(), queries.id.to_numpy(), queries.lists.to_numpy()
            names, place = np.unique(vectors.list.to_numpy(), return_inverse=True)
            for part in _parts(len(q), len(x)):
                own, lists = asks[part], opened[part]
                row, to = np.repeat(np.arange(len(own)), [len(v) for v in lists]), np.concatenate(lists)
                at = np.minimum(np.searchsorted(names, to), len(names) - 1)
                open_ = np.zeros((len(own), len(names)), bool)
                open_[row[names[at] == to], at[names[at] == to]] = True
                score = np.where(open_[:, place] & (ids != own[:, None]), q[part] @ x.T, -np.inf)
                n = min(COPIES * k, len(x))
                least = np.partition(score, len(x) - n, axis=1)[:, len(x) - n]
                near = np.isfinite(score) & (score >= np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)[:, None])
                for again in (False, True):
                    row, at = np.nonzero(near)
                    # Sums in one order for every vector, so that equal vectors have equal scores wherever they lie.
                    exact = (x[at] * q[part][row]).sum(axis=1)
                    order = np.lexsort((ids[at], -exact, row))
                    row, at, exact = row[order], at[order], exact[order]
                    # A vector in several lists, or rows, counts once.
                    first = np.sort(np.unique(np.stack((row, ids[at])), axis=1, return_index=True)[1])
                    row, at, exact = row[first], at[first], exact[first]
                    few = np.flatnonzero((np.bincount(row, minlength=len(own)) < k) & (np.isfinite(score).sum(axis=1) > near.sum(axis=1)))
                    if again or not len(few):
                        break
                    near[few] = np.isfinite(score[few])  # many rows repeat an id: look at all
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < k
                found.append((own[row[top]], ids[at[top]], exact[top]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return run


def shelves(counts: dict[int, int], centroids: Centroids, block: int = BLOCK) -> tuple[np.ndarray, dict[int, int]]:
    """The shelf of each list (-1: no vectors), and each shelf's number of blocks. Lists that lie close share a shelf of about block vectors,
    so a query meets few shelves; a list larger than that fills a shelf of its own, in blocks."""
    points = centroids.points - centroids.points.mean(axis=0)
    order = np.argsort(points @ np.linalg.svd(points, full_matrices=False)[2][0], kind="stable")
    shelf, rows = np.full(len(points), -1), [0]
    for x in order.tolist():
        n = counts.get(x, 0)
        if n:
            if rows[-1] and rows[-1] + n > block:
                rows.append(0)
            shelf[x] = len(rows) - 1
            rows[-1] += n
    return shelf, {i: max(1, -(-n // block)) for i, n in enumerate(rows)}


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part: no nulls, finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).try_cast("long").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.where(good).select(F.col(id_col).try_cast("long").alias("id"), v.alias("vector"))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", open_ratio: float | None = None,
            lists: int | None = None, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product found for each row where is_query holds.

    A query's own id is no candidate; ties go to the smaller id; with fewer candidates all found are returned. Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite components take no part; nor do ids that aren't whole numbers, and vectors
    of another size than the most common one. Rows that repeat an id and a vector are one candidate. An empty table gives no rows; other
    columns play no part.

    open_ratio: by default fitted on the sample, so that it holds recall of the neighbours there; lists: by default 2 sqrt(n). block: vectors
    that one task compares at a time.
    """
    spark = vectors.sparkSession
    names = "query_id long, rank int, vec_id long, score double"
    clean = usable(vectors, id_col, vector_col).withColumn("size", F.size("vector"))
    facts = clean.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, e: s + e * e))).alias("most")).orderBy(F.desc("n"), "size").first()
    if facts is None:
        return spark.createDataFrame([], names)
    clean = clean.where(F.col("size") == facts["size"]).drop("size")
    count = int(min(MOST_LISTS, max(1, lists or round(2 * facts["n"] ** 0.5))))
    chosen = clean.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, PER_CENTROID * count)).select("vector")
    sample = _units(np.array([r.vector for r in chosen.collect()]), facts["most"])
    distinct = np.unique(sample, axis=0)
    index = Centroids(balanced_centroids(distinct, min(count, len(distinct))), facts["most"])
    # As many of the sample lie as near as a probe's k nearest of all.
    ratio, width = fitted_ratio(sample, index.points, max(1, round(k * len(sample) / facts["n"])), recall)
    if open_ratio is not None:
        ratio, width = open_ratio, 64

    work = workspace(spark, "neighbours")
    filed = written(clean.mapInArrow(_file(index, facts["size"]), "list int, id long, vector array<double>"), "lists", work)
    facts_of = filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect()  # MOST_LISTS rows at most
    counts = {r["list"]: r["n"] for r in facts_of}
    shelf, blocks = shelves(counts, index, block)
    held = np.zeros(len(index.points), np.int64)
    held[[r["list"] for r in facts_of]] = [r["ids"] for r in facts_of]
    # Of so many filed vectors k at least are different ones and not the query.
    opens = _open(index, facts["size"], ratio, width, held, COPIES * (k + 1), shelf)
    opened = written(clean.where(is_query(F.col("id"))).mapInArrow(opens, "shelf int, id long, vector array<double>, lists array<int>"), "opened", work)
    # Tables of one row per list or shelf: MOST_LISTS of them at most.
    place = F.broadcast(spark.createDataFrame([(x, int(shelf[x])) for x in counts], "list int, shelf int"))
    size = spark.createDataFrame(list(blocks.items()), "shelf int, vs int").join(opened.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qs")), "shelf")
    size = F.broadcast(size)
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = opened.join(size, "shelf").select("shelf", part("qs").alias("q"), every("vs").alias("v"), "id", "vector", "lists")
    right = filed.join(place, "list").join(size, "shelf").select("shelf", part("vs").alias("v"), every("qs").alias("q"), "id", "vector", "list")
    met = left.groupBy("shelf", "v", "q").cogroup(right.groupBy("shelf", "v", "q")).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    # k rows for each block that a query meets; copies of a vector in several lists are one element of the set.
    best = met.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    out = written(best.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score")), "nearest")
    remove(spark, work)
    return out
