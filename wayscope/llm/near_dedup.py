"""Near-duplicates by DartMinHash: documents whose shingles of five words have a Jaccard similarity of 0.8 or more.

1. A document's distinct shingles are regions as high as their weights. Darts, a Poisson process per shingle drawn from its hash, fall on
   (rank, weight); only those up to a rank that fits the document's total weight are thrown, about k ln k in all. Each dart has a coordinate;
   the earliest per coordinate is the signature, whose agreement estimates the (weighted) Jaccard similarity.
2. Documents with the same shingles become one class. Classes meet in bands of the signature; each bucket has one centre, and each class is
   compared with the centre that it shares most buckets with, so a group of any size costs a row per member. Linked classes form components.
3. Buckets that still hold several components are closed: signatures name the classes that have a likely partner in another component there
   (a pair counts in the first bucket it shares), and the shingles of those meet in blocks of bounded size. Every likely pair between
   components is verified exactly, unless links found before have joined its components; what comes out are the links that join some, fewer
   than the classes that went in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import fresh, remove, require_whole_ids, workspace, written
from .words import Words, chunks, gram_hashes, mixed, word_hashes, words_of, worker_object

SHINGLE = 5
SIMILARITY = 0.8
K = 125
MISS = 1e-4  # of the pairs at the similarity, the share that may meet in no band
SPREAD = 5  # deviations of the estimate that a likely pair may lie below the similarity
BLOCK = 2048  # classes that a task holds of one of two blocks
BLOCK_SHINGLES = 1 << 19  # of them and of a star's members
STAR = 256  # members that one task compares with their centre
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NONE = -(2**63)


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each text, A-Z lower-cased; a text of 1 to n-1 words is one shingle."""
    words = words_of(texts)
    hashes = word_hashes(Words(_LOWER[words.data], *words[1:]))
    size = np.diff(words.of)
    row = np.repeat(np.arange(len(size)), size)
    grams = gram_hashes(hashes, n)
    whole = np.flatnonzero(np.arange(len(grams)) + n <= words.of[1:][row[: len(grams)]])
    short = np.flatnonzero((size > 0) & (size < n))
    lone = np.array([gram_hashes(hashes[words.of[d] : words.of[d + 1]], int(size[d]))[0] for d in short], np.uint64)
    row, code = np.concatenate((row[whole], short)), np.concatenate((grams[whole], lone))
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[first], code[first], np.diff(np.concatenate((first, [len(row)])))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """rows x k values of 64 bits; rows without elements are 0. weight: whole numbers from 1 (any scale; a unit is a strip of a region)."""
    out = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weight, rows)
    todo, theta = total > 0, k * (math.log(k) + 3)
    while todo.any():
        own = todo[row]
        best, sign = np.full(rows * k, np.inf), np.zeros(rows * k, np.uint64)
        low = 0  # strips of weight [0, 1), [1, 2), [2, 4), ...: a heavier region has the darts of a lighter one, and more
        while (part := own & (weight > low)).any():
            high = max(1, 2 * low)
            _throw(row[part], code[part], weight[part], low, high, theta / total[row[part]], k, best, sign)
            low = high
        best, sign = best.reshape(rows, k), sign.reshape(rows, k)
        full = todo & np.isfinite(best).all(axis=1)
        out[full] = sign[full]
        todo &= ~full
        theta *= 2  # darts of higher rank change no coordinate that has one
    return out


def _throw(row, code, weight, low: int, high: int, limit, k: int, best, sign) -> None:
    """Darts of one strip of each element, rank by rank in growing blocks, the same blocks whatever the limit."""
    seed = mixed(code + np.uint64(low * 0x9E3779B97F4A7C15 % 2**64))
    rank, drawn, block = np.zeros(len(row)), 0, 1
    while len(row):
        i = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64)
        darts = mixed(seed[:, None] + i * np.uint64(0xD1342543DE82EF95))
        ranks = rank[:, None] + np.cumsum(-np.log(_uniform(darts)), axis=1) / (high - low)
        hit = ranks < limit[:, None]
        if high - low > 1:
            hit &= low + _uniform(mixed(darts ^ np.uint64(0x2545F4914F6CDD1D))) * (high - low) < weight[:, None]
        e, _ = np.nonzero(hit)
        value, at = mixed(darts[hit]), ranks[hit]
        key = row[e] * k + ((value >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, key, at)
        won = best[key] == at
        sign[key[won]] = value[won]
        on = ranks[:, -1] < limit
        row, seed, weight, limit, rank = row[on], seed[on], weight[on], limit[on], ranks[on, -1]
        drawn, block = drawn + block, min(64, block * 4)


def bands(similarity: float, k: int = K, miss: float = MISS) -> tuple[int, int]:
    """How many bands of how many coordinates: as many coordinates as leave a pair at the similarity without a common band in a share of miss at most."""
    rows = next((r for r in range(k, 1, -1) if (1 - similarity**r) ** (k // r) <= miss), 1)
    return k // rows, rows


def likely(similarity: float, k: int = K) -> float:
    """The least estimate that a pair at the similarity has, but for SPREAD deviations."""
    return similarity - SPREAD * math.sqrt(similarity * (1 - similarity) / k)


def _class_of(row, code, count, n: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two values of 64 bits for each row's set of shingles."""
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    same = mixed(code + count.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) if weighted else code
    np.add.at(one, row, mixed(same))
    np.add.at(two, row, mixed(same ^ np.uint64(0x94D049BB133111EB)))
    return one.view(np.int64), two.view(np.int64)


def _sign(weighted: bool, similarity: float):
    count_of, rows = bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_object()
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):  # darts are many for short texts
                row, code, count = shingles(part.column("text"))
                n = part.num_rows
                sign = signatures(row, code, count if weighted else np.ones_like(count), n)
                band = np.zeros((n, count_of), np.uint64)
                for r in range(rows):
                    band = mixed(band + sign[:, r : count_of * rows : rows] + np.arange(count_of, dtype=np.uint64))
                one, two = _class_of(row, code, count, n, weighted)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(one), pa.array(two), pa.array(np.bincount(row, minlength=n)),
                     pa.FixedSizeListArray.from_arrays(pa.array(band.reshape(-1).view(np.int64)), count_of).cast(pa.list_(pa.int64())), pa.array([x.tobytes() for x in sign.astype(np.uint8)], pa.binary())],
                    ["doc_id", "one", "two", "n", "bands", "sign"],
                )

    return run


def _sets(weighted: bool):
    """Rows (id, one, shingles): sorted codes of 64 bits, then, if weighted, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, code, count = shingles(part.column("text"))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                sets = [code[a:b].tobytes() + (count[a:b].astype(np.int64).tobytes() if weighted else b"") for a, b in zip(at[:-1], at[1:], strict=True)]
                one, _ = _class_of(row, code, count, part.num_rows, weighted)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(one), pa.array(sets, pa.binary())], ["id", "one", "shingles"])

    return run


class Sets:
    """The shingles of a group's rows, numbered within the group."""

    def __init__(self, column: pa.ChunkedArray, weighted: bool):
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in column]
        size = np.array([len(x) // (2 if weighted else 1) for x in own], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        codes, self.code = np.unique(np.concatenate([x[:n] for x, n in zip(own, size, strict=True)]), return_inverse=True)
        self.count = np.concatenate([x[n:] for x, n in zip(own, size, strict=True)]) if weighted else None
        self.total = np.array([x[n:].sum() for x, n in zip(own, size, strict=True)], np.int64) if weighted else size
        self.mark = np.zeros(len(codes), np.int64)

    def similarity(self, x: int, others: np.ndarray) -> np.ndarray:
        """The exact similarity of row x with each of the others."""
        mine = slice(self.start[x], self.end[x])
        self.mark[self.code[mine]] = 1 if self.count is None else self.count[mine]
        start, size = self.start[others], self.end[others] - self.start[others]
        upto = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
        both = self.mark[self.code[at]]
        if self.count is not None:
            both = np.minimum(both, self.count[at])
        self.mark[self.code[mine]] = 0
        shared = np.diff(np.concatenate(([0], np.cumsum(both)))[upto])
        return shared / np.maximum(1, self.total[x] + self.total[others] - shared)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of rows sorted by keys: the rows of each key, one table after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        begin = 0
        if held and (key[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for end in edge.tolist():
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held, begin = [], end
        held.append(batch.slice(begin))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _links_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _star(weighted: bool, similarity: float):
    """Rows sorted by a, part, member: a centre, then members that share a bucket with it. Out: the members that are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for table in _groups(batches, ["a", "part"]):
            a, ids, member = _numbers(table, "a", "id", "member")
            own, centres = np.flatnonzero(member == 1), np.flatnonzero(member == 0)
            if not len(own):
                continue
            sets = Sets(table.column("shingles"), weighted)
            good = np.zeros(len(own), bool)
            for x in centres.tolist():  # several, if rows repeat an id
                good |= sets.similarity(x, own) >= similarity
            found.append((a[own[good]], ids[own[good]]))
            n += 1
            if n == 1024:
                yield _links_of(found)
                found, n = [], 0
        if found:
            yield _links_of(found)

    return run


class _Group:
    """Classes of one bucket, in block i or j, and which of them are likely partners there."""

    def __init__(self, table: pa.Table, least: float):
        bucket, i, j, block, self.label, self.ids = _numbers(table, "bucket", "i", "j", "block", "label", "id")
        self.sign = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sign")])
        self.band = np.stack([x.values.to_numpy() for x in table.column("bands")])
        self.least, self.place = least, int(np.flatnonzero(self.band[0] == bucket[0])[0])
        left, self.right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        names, size = np.unique(self.label, return_counts=True)
        # Of any two components one at least is another than the largest: its members look for partners.
        small = self.label != names[size.argmax()] if len(names) else np.zeros(0, bool)
        self.once = bool(i[0] == j[0])
        self.sides = [(left[small[left]], self.right)] if self.once else [(left[small[left]], self.right), (self.right[small[self.right]], left[~small[left]])]
        self.small = small

    def likely(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, partners and whether they are likely, some rows at a time; a pair comes once, in the first bucket that it shares."""
        for rows, to in self.sides:
            for first in range(0, len(rows), 256):
                part = rows[first : first + 256]
                open_ = self.label[part][:, None] != self.label[to]
                if self.once:
                    open_ &= ~self.small[to] | (to > part[:, None])
                for k in range(self.place):
                    open_ &= self.band[part, k][:, None] != self.band[to, k]
                equal = np.zeros(open_.shape, np.uint8)
                for k in range(K):
                    equal += self.sign[part, k][:, None] == self.sign[to, k]
                open_ &= (equal / K - 1 / 256) / (1 - 1 / 256) >= self.least  # less what bytes agree by chance
                yield part, to, open_


def _meet(least: float):
    """Rows sorted by bucket, i, j: the classes that have a likely partner in another component, as (bucket, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["bucket", "i", "j"]):
            group = _Group(table, least)
            hit = np.zeros(table.num_rows, bool)
            for rows, to, good in group.likely():
                hit[rows] |= good.any(axis=1)
                hit[to] |= good.any(axis=0)
            if hit.any():
                ids = np.unique(group.ids[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), table.column("bucket")[0].as_py())), pa.array(ids)], ["bucket", "id"])

    return run


def _close(weighted: bool, similarity: float):
    """Rows sorted by bucket, i, j: links between components, found by verifying their likely pairs until they are one. Fewer links than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["bucket", "i", "j"]):
            group, sets = _Group(table, likely(similarity)), Sets(table.column("shingles"), weighted)
            own, found = group.label.copy(), []
            for rows, to, good in group.likely():
                for x, partners in zip(rows.tolist(), good, strict=True):
                    others = to[partners]
                    others = others[own[others] != own[x]]
                    if not len(others):
                        continue
                    for y in others[sets.similarity(x, others) >= similarity].tolist():
                        if own[y] != own[x]:
                            found.append((group.ids[[x]], group.ids[[y]]))
                            own[own == own[y]] = own[x]
            if found:
                yield _links_of(found)

    return run


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows of each bucket once for each pair of blocks that theirs is one of."""
    met = rows.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("blocks", "_other")


def _sorted(rows: DataFrame, *keys: str, then: str | None = None) -> DataFrame:
    """Dealt to as many tasks as the session shuffles to: rows are small for the work on them, so they aren't coalesced by size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *([then] if then else []))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weighted: bool = False,
            block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, star: int = STAR) -> DataFrame:
    """doc_id and class_id (the smallest id of the class) of each row.

    Classes are the components of all pairs whose distinct shingles of five words (A-Z lower-cased) have a Jaccard similarity of at least
    similarity; weighted: shingles count as often as they occur. Texts without words, and null, are classes by themselves. Texts of one to
    four words are one shingle. Of what meets, nothing is left unverified; a pair at the similarity meets in no band, or lies too far below
    it by its signature, with a chance of 5e-5 and 3e-7 at 0.8. A null id counts as the smallest; ids that aren't whole numbers raise.
    Rows that share an id should share a text: they stand for one document, so what is like either text is linked to the id. An empty table
    gives no rows; other columns play no part. block, block_shingles, star: what one task holds at a time.
    """
    require_whole_ids(docs, id_col)
    spark = docs.sparkSession
    work = workspace(spark, "near")
    texts = docs.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(_NONE)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(texts.mapInArrow(_sign(weighted, similarity), "doc_id long, one long, two long, n long, bands array<long>, sign binary"), "signed")
    heads = signed.where("n > 0").groupBy("one", "two").agg(F.min_by(F.struct("doc_id", "n", "bands", "sign"), "doc_id").alias("x"))
    heads = written(heads.select("one", "two", F.col("x.doc_id").alias("id"), "x.n", "x.bands", "x.sign"), "heads")
    member = signed.where("n > 0").select("doc_id", "one", "two").join(heads.select("one", "two", "id"), ["one", "two"]).select("doc_id", "id")
    buckets = heads.select("id", "n", F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").drop("last")
    buckets = written(buckets.join(centres, "bucket"), "buckets", work)
    # The one exchange of texts: of those classes that meet others.
    met = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = written(texts.join(met.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(weighted), "id long, one long, shingles binary"), "sets", work)

    # One pair for each class: with the centre that it shares most buckets with. Their number grows with the members, not with the buckets.
    shared = buckets.where("id <> a").groupBy("id", "a").agg(F.count(F.lit(1)).alias("shares"), F.max("n").alias("n"))
    pairs = shared.groupBy("id").agg(F.max(F.struct("shares", F.bitwise_not("a").alias("a"), "n")).alias("x")).select("id", F.bitwise_not("x.a").alias("a"), "x.n")
    pairs = written(pairs, "pairs", work)
    # A centre goes to each part of its members.
    parts = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / star), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("id", "a", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    hubs = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    stars = _sorted(members.unionByName(hubs).join(sets.select("id", "shingles"), "id"), "a", "part", then="member")
    found = written(stars.mapInArrow(_star(weighted, similarity), "a long, b long"), "links", work)
    joined = components(found, work)

    # What the centres left apart, but for what no link can join.
    label = written(buckets.join(joined, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")), "labels", work)
    several = label.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("n")).where("l <> m")
    several = several.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    known = heads.select("id", "one", "n", "bands", "sign")
    rows = label.join(several.select("bucket"), "bucket", "left_semi").join(known.drop("one", "n"), "id")
    near = _sorted(_dealt(rows, several), "bucket", "i", "j").mapInArrow(_meet(likely(similarity)), "bucket long, id long").distinct()
    rows = written(near.join(label, ["bucket", "id"]).join(known, "id"), "near", work)
    size = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    rows = _dealt(rows, size).join(sets, ["id", "one"])
    more = written(_sorted(rows, "bucket", "i", "j").mapInArrow(_close(weighted, similarity), "a long, b long"), "links", work)
    if not more.isEmpty():
        joined = components(found.unionAll(more), work)
    joined = written(joined, "joined")
    remove(spark, work)
    whole = member.join(joined, "id", "left").select("doc_id", F.coalesce("label", "id").alias("class_id"))
    every = whole.unionByName(signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    null = lambda c: F.when(F.col(c) != F.lit(_NONE), F.col(c)).alias(c)
    return every.select(null("doc_id"), null("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is their class's smallest, all columns as they were."""
    name = fresh("gone", docs)
    gone = classes(docs, id_col, text_col, similarity).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(name)).distinct()
    own = F.coalesce(F.col(id_col).try_cast("long"), F.lit(_NONE))
    return docs.join(gone.hint("shuffle_hash"), own == F.coalesce(F.col(name), F.lit(_NONE)), "left_anti")
