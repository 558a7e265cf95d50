"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted letter puts one count up by one; one replaced letter puts one up and one down (an L1 distance of at most two). So what lies
near a word of length L is among the words of length L and L + 1 whose counts lie in that range, which a k-d tree finds by leaving out every
box farther off; the order of the letters is then compared.

Words are dealt to cells: a tree for each length, grown on a bounded sample, whose leaves are the cells. A word is a point in one cell of its
own length, and asks in the cells of its length and the next one that its range reaches. Each cell has a tree of its own over all its points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import workspace, written

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Words that trees of cells are grown on (about), and the length up to which words have such trees (longer ones: one cell a length).
SAMPLE, LONGEST = 60_000, 64
#: Points of a cell as aimed at; points and bytes of words that a task holds of one cell at most (beyond, the cell is cut into blocks).
CELL, HELD, HELD_BYTES = 8192, 50_000, 16 << 20
LEAF, HEAVY = 24, 256
_LETTERS = 90  # a to z, U+00C0 to U+00FF
_AT = np.zeros(256, np.int64)
_AT[97:123], _AT[0xC0:] = np.arange(26), np.arange(26, 90)
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Different words that a task counts before it hands them on.
COUNTED = 200_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of whole texts with how often each occurs, as counted so far whenever so many different ones are held."""
    found: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return done

    for batch in batches:
        for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text:
                continue
            salt = crc32(f"{name}:".encode())
            for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                h = crc32(run.encode(), salt)
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                found[run] = found.get(run, 0) + n
            if len(found) > COUNTED:
                yield out()
    if found:
        yield out()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: of each maximal run of letters (a to z in either case, U+00C0 to U+00FF), A-Z lower-cased, that is at least LEAST_LENGTH long and
    occurs LEAST_COUNT times. A run loses a letter where a hash of the row's id and the run says so. Counts combine before the shuffle."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_runs, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def letters(own: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(own).encode("latin-1"), np.uint8).reshape(len(own), length)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    """How often each row has each letter."""
    out = np.zeros((len(rows), _LETTERS), np.int32)
    step = max(1, (1 << 22) // max(1, rows.shape[1]))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        at = _AT[part] + np.arange(len(part))[:, None] * _LETTERS
        out[a : a + step] = np.bincount(at.ravel(), minlength=len(part) * _LETTERS).reshape(-1, _LETTERS)
    return out


class Leaf(NamedTuple):
    number: int
    members: Any


class Split(NamedTuple):
    """Counts of one letter up to cut go below, the others above."""

    letter: int
    cut: int
    below: Any
    above: Any


def grow(counts: np.ndarray, leaf: int) -> Leaf | Split:
    """A k-d tree whose leaves have at most leaf members, or members of equal counts."""
    number = iter(range(len(counts) + 1))

    def node(own: np.ndarray) -> Leaf | Split:
        if len(own) > leaf:
            v = counts[own]
            letter = int(v.var(axis=0).argmax())
            x = v[:, letter]
            upto = np.cumsum(np.bincount(x))
            cut = int(np.abs(upto[:-1] * 2 - len(own)).argmin()) if len(upto) > 1 else 0
            low = x <= cut
            if low.any() and not low.all():
                return Split(letter, cut, node(own[low]), node(own[~low]))
        return Leaf(next(number), own)

    return node(np.arange(len(counts)))


def bare(tree: Leaf | Split) -> Leaf | Split:
    """A tree without its leaves' members."""
    return Leaf(tree.number, None) if isinstance(tree, Leaf) else Split(tree.letter, tree.cut, bare(tree.below), bare(tree.above))


_FAR = 1 << 30


def reached(tree: Leaf | Split, counts: np.ndarray, rise: np.ndarray, fall: np.ndarray) -> Iterator[tuple[Leaf, np.ndarray]]:
    """Each leaf whose box the ranges of some rows of counts meet, with those rows. A range allows rise[i] more and fall[i] fewer letters in all."""
    none = np.zeros(len(counts), np.int32)
    todo = [(tree, np.arange(len(counts)), none, none, {}, {})]
    while todo:
        node, own, up, down, least, most = todo.pop()
        if isinstance(node, Leaf):
            yield node, own
            continue
        k = node.letter
        x = counts[own, k]
        old, new = most.get(k, _FAR), min(most.get(k, _FAR), node.cut)
        fewer = down + np.maximum(0, x - new) - np.maximum(0, x - old)
        stay = fewer <= fall[own]
        if stay.any():
            todo.append((node.below, own[stay], up[stay], fewer[stay], least, most | {k: new}))
        old, new = least.get(k, 0), max(least.get(k, 0), node.cut + 1)
        more = up + np.maximum(0, new - x) - np.maximum(0, old - x)
        stay = more <= rise[own]
        if stay.any():
            todo.append((node.above, own[stay], more[stay], down[stay], least | {k: new}, most))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b is a with one letter put in: what agrees from the left and from the right makes up all of a."""
    n = a.shape[1]
    front, back = a == b[:, :-1], (a == b[:, 1:])[:, ::-1]
    left = np.where(front.all(axis=1), n, front.argmin(axis=1))
    right = np.where(back.all(axis=1), n, back.argmin(axis=1))
    return left + right >= n


def _parity(counts: np.ndarray) -> np.ndarray:
    """64 bits of which one letter more or less flips one."""
    bit = np.uint64(1) << (np.arange(_LETTERS, dtype=np.uint64) % np.uint64(64))
    out = np.zeros(len(counts), np.uint64)
    for k in range(_LETTERS):
        out ^= np.where(counts[:, k] & 1, bit[k], np.uint64(0))
    return out


class Cell:
    """Points of one length, to be asked for those one edit from words of that length or one shorter."""

    def __init__(self, own: list[str], length: int):
        self.length, self.rows = length, letters(own, length)
        counts = letter_counts(self.rows)
        self.tree, self.parity = grow(counts, LEAF), _parity(counts)

    def near(self, own: list[str], shorter: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places in own and of points of all pairs one edit apart."""
        rows = letters(own, self.length - shorter)
        counts = letter_counts(rows)
        parity, test = _parity(counts), one_inserted if shorter else one_replaced
        kept, waiting, n = [np.zeros((2, 0), np.int64)], [], 0

        def check() -> None:
            """Keep of the waiting pairs those whose letters are in order, so that few pairs wait at a time."""
            nonlocal n
            if waiting:
                a, b = np.concatenate([x for x, _ in waiting]), np.concatenate([y for _, y in waiting])
                step = max(1, (1 << 21) // self.length)
                for k in range(0, len(a), step):
                    i, j = a[k : k + step], b[k : k + step]
                    holds = test(rows[i], self.rows[j])
                    kept.append(np.stack((i[holds], j[holds])))
            waiting.clear()
            n = 0

        for leaf, some in reached(self.tree, counts, np.ones(len(own), np.int32), np.full(len(own), 0 if shorter else 1, np.int32)):
            if len(leaf.members) > HEAVY:
                waiting.append(self._by_halves(rows, some, leaf.members, shorter))
            else:
                i, j = np.nonzero(np.bitwise_count(parity[some][:, None] ^ self.parity[leaf.members][None, :]) <= (1 if shorter else 2))
                waiting.append((some[i], leaf.members[j]))
            n += len(waiting[-1][0])
            if n > 200_000:
                check()
        check()
        a, b = np.concatenate(kept, axis=1)
        return a, b

    def _by_halves(self, rows: np.ndarray, some: np.ndarray, members: np.ndarray, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of many points with the same letters: those that agree with a word in its first or last half, one of which an edit leaves alone."""
        h = self.length // 2
        pairs: set[tuple[int, int]] = set()
        for mine, theirs in ((slice(0, h), slice(0, h)), (slice(h - shorter, None), slice(h, None))):
            at: dict[bytes, list[int]] = {}
            for j in members.tolist():
                at.setdefault(self.rows[j, theirs].tobytes(), []).append(j)
            pairs.update((i, j) for i in some.tolist() for j in at.get(rows[i, mine].tobytes(), ()))
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


_DEALT = pa.schema([("length", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), ("side", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
_DEALT_TYPE = "length int, cell int, block int, side int, word string, n long"


def _deal(trees: dict[int, Leaf | Split], blocks: dict[tuple[int, int], int], asking: bool):
    """Rows of words as points of their cell (side 0) and, if asking, in every cell and block that their range reaches (side 1, or 2 where the points
    are one longer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            sizes = np.array([len(w) for w in own], np.int64)
            out: list[tuple[int, int, int, int, np.ndarray]] = []
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                step = max(1, (1 << 24) // length)
                for part in (at[k : k + step] for k in range(0, len(at), step)):
                    counts = letter_counts(letters([own[i] for i in part], length))
                    room = lambda x, n=len(part): np.full(n, x, np.int32)
                    for side, size, rise, fall in ((0, length, 0, 0), (1, length, 1, 1), (2, length + 1, 1, 0)):
                        if side and not asking or size not in trees and size <= LONGEST:
                            continue  # no point of that length at all
                        for leaf, some in reached(trees.get(size, Leaf(0, None)), counts, room(rise), room(fall)):
                            n = blocks.get((size, leaf.number), 1)
                            if side or n == 1:
                                out += [(size, leaf.number, b, side, part[some]) for b in range(n)]
                            else:
                                block = np.array([crc32(own[i].encode()) % n for i in part[some]])
                                out += [(size, leaf.number, b, 0, part[some[block == b]]) for b in np.unique(block).tolist()]
            index = np.concatenate([np.zeros(0, np.int64), *(x[4] for x in out)])
            many = [len(x[4]) for x in out]
            head = [pa.array(np.repeat(np.array([x[k] for x in out], np.int32), many)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*head, batch.column("word").take(pa.array(index)), batch.column("n").take(pa.array(index))], schema=_DEALT)

    return run


_PAIRS = "word string, other string, other_n long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _DEALT in order of cell, block and side. A cell's points are held, and each batch of words that ask is answered by itself."""
    key, held, cell, pool, pool_n = None, [], None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        head = np.stack([batch.column(k).to_numpy() for k in range(4)])
        edge = [0, *(np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            length, number, block, side = head[:, a].tolist()
            if key != (length, number, block):
                key, held, cell = (length, number, block), [], None
            part = batch.slice(a, b - a)
            if side == 0:
                held.append(part)
                continue
            if not held:
                continue  # a cell of the sample's without points
            if cell is None:
                pool = pa.concat_arrays([x.column("word") for x in held])
                pool_n = pa.concat_arrays([x.column("n") for x in held])
                cell = Cell(pool.to_pylist(), length)
            step = max(256, (1 << 22) // length)
            for own in (part.slice(k, step) for k in range(0, part.num_rows, step)):
                i, j = cell.near(own.column("word").to_pylist(), side == 2)
                if not len(i):
                    continue
                i, j = pa.array(i), pa.array(j)
                mine, mine_n, theirs, theirs_n = own.column("word").take(i), own.column("n").take(i), pool.take(j), pool_n.take(j)
                yield pa.RecordBatch.from_arrays([mine, theirs, theirs_n], ["word", "other", "other_n"])
                if side == 2:  # words never ask among shorter ones
                    yield pa.RecordBatch.from_arrays([theirs, mine, mine_n], ["word", "other", "other_n"])


def near_words(counted: DataFrame) -> DataFrame:
    """word, other, other_n: every ordered pair of words (word, n; each word once) that differ by exactly one inserted, deleted or replaced letter.
    A word has at most some sixty such neighbours for each of its letters, so rows stay in proportion to the words."""
    size = F.length("word")
    sizes = {r.length: r.n for r in counted.where(size <= LONGEST).groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # About SAMPLE words, whichever have the smallest hashes: each task sends its share.
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    some = [r.word for r in counted.where((size <= LONGEST) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))).select("word").collect()]
    trees: dict[int, Leaf | Split] = {}
    for length, n in sizes.items():
        own = [w for w in some if len(w) == length]
        leaf = max(8, len(own) * CELL // n)
        trees[length] = bare(grow(letter_counts(letters(own, length)), leaf)) if own else Leaf(0, None)
    placed = counted.mapInArrow(_deal(trees, {}, False), _DEALT_TYPE).groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.ceil(F.col("n") / HELD), F.ceil(F.col("n") * F.col("length") / HELD_BYTES))
    # Cells that need several blocks only: fewer than there are blocks of such a size in the table.
    blocks = {(r.length, r.cell): int(r.need) for r in placed.withColumn("need", need).where("need > 1").collect()}
    dealt = counted.mapInArrow(_deal(trees, blocks, True), _DEALT_TYPE)
    return dealt.repartition("length", "cell", "block").sortWithinPartitions("length", "cell", "block", "side").mapInArrow(_search, _PAIRS)


def forms(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: of each word (word, n) the number of words near it, and the most frequent of these (of equally frequent ones the
    least in code-point order) where it is at least times as frequent; null otherwise."""
    best = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    out = counted.join(best, "word", "left")
    clear = -F.col("best.m") >= F.lit(times) * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best.other")).alias("form"), F.when(clear, -F.col("best.m")).alias("form_n"))


def _few_files(words: DataFrame) -> DataFrame:
    """Tables of words are small beside the texts they come from: four partitions share a task and a file."""
    return words.coalesce(max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def roots(formed: DataFrame, within: str | None = None) -> DataFrame:
    """formed with root: where forms lead in the end, the word itself if it has none. Each form is times as frequent as the one before, so ways are
    short; a step goes twice as far as the last one."""
    links = written(_few_files(formed.where("form is not null").select("word", F.col("form").alias("root"))), "links", within)
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = written(_few_files(links.join(on, "root", "left")), "links", within)
        if met.where("further is not null").isEmpty():
            break
        links = met.select("word", F.coalesce("further", "root").alias("root"))
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (see words()); one row a word.

    Null and empty texts have no words; a null id counts as an empty one; rows that share an id or a text each count; words of any length take
    part; other columns play no part; an empty table gives no rows.
    """
    at = workspace(docs.sparkSession, "spelling")
    counted = written(_few_files(words(docs, id_col, text_col)), "words", at)
    formed = written(_few_files(forms(counted)), "forms", at)
    return roots(formed, at).select("word", "form", "root", "n", "n_near", "form_n")
