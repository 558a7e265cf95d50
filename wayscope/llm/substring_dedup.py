"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 13 grams of eight words in each window of 20 words, the one with the smallest hash
(the first, if tied). Equal windows have equal anchors at equal places, so whatever repeats over 20 words meets at an anchor.
An anchor stands for a run of at most 13 windows; the words of that run, to both sides of the anchor, are its stretch.

1. Anchors with the same stretch repeat as a whole: all but the first are marked, without looking at texts again. What repeats
   within a scan partition's buffer is settled there, so that a passage in a third of all rows sends a row per buffer.
2. Where an anchor has several stretches, the first of each is extended window by window against the other ones: the windows'
   hashes meet in a second, small aggregation.
3. Marked stretches join the documents, merge into maximal repeats there, and their words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import require_whole_ids, written
from .words import chunks, gram_hashes, mixed, power_table, word_hashes, words_of

WINDOW = 20
GRAM = 8
_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 2**64)
_BUFFER = 250_000
_ANCHORS = "key long, anchor long, stretch long, doc_id long, start int, windows int, settled boolean"


def _stretches(batch: pa.RecordBatch, window: int, gram: int) -> list[np.ndarray]:
    """anchor, stretch, row, start and windows of every anchor; start counts words within the document."""
    words = words_of(batch.column("text"))
    hashes = word_hashes(words)
    per = window - gram + 1
    if len(hashes) < window:
        return [np.zeros(0, np.int64)] * 5
    grams = gram_hashes(hashes, gram)
    row = np.repeat(np.arange(batch.num_rows), np.diff(words.of))
    first = np.arange(len(hashes) - window + 1)
    at = np.flatnonzero(first + window <= words.of[1:][row[: len(first)]])
    if not len(at):
        return [np.zeros(0, np.int64)] * 5
    seed = (np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1) + first)[at]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(seed) != 0))))
    begin, count, seed = at[new], np.diff(np.concatenate((new, [len(at)]))), seed[new]
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power_table(len(hashes), _STEP))))
    whole = (prefix[begin + count - 1 + window] - prefix[begin]) * power_table(len(hashes), _BACK)[begin]
    whole = mixed(whole + ((seed - begin) * 64 + count).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return [grams[seed].view(np.int64), whole.view(np.int64), row[begin], begin - words.of[row[begin]], count]


def _settle(parts: list[tuple]) -> pa.RecordBatch:
    """Of the anchors with the same stretch in the buffer, all but the first are settled and travel by document."""
    anchor, stretch, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, doc, stretch, anchor))
    anchor, stretch, doc, start, count = (x[order] for x in (anchor, stretch, doc, start, count))
    same = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (stretch[1:] == stretch[:-1])))
    head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    again = same & ((doc != doc[head]) | (start != start[head]))
    key = np.where(again, mixed(doc.astype(np.uint64) + start.astype(np.uint64)).view(np.int64), anchor)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, anchor, stretch, doc, start.astype(np.int32), count.astype(np.int32), again)], ["key", "anchor", "stretch", "doc_id", "start", "windows", "settled"])


def _seeds(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                anchor, stretch, row, start, count = _stretches(part, window, gram)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                parts.append((anchor, stretch, ids[row], start, count))
                held += len(anchor)
                if held >= _BUFFER:
                    yield _settle(parts)
                    parts, held = [], 0
        if held:
            yield _settle(parts)

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, stretch, document and start: marks repeats of a stretch, and the first of each where an anchor has several."""

    def out(doc, start, count, extend):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(extend)], ["doc_id", "start", "windows", "extend"])

    last = None  # anchor, stretch, and document, start, windows of its first; then whether it has been sent
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, stretch, doc, start, count, settled = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "stretch", "doc_id", "start", "windows", "settled"))
        if settled.any():
            yield out(doc[settled], start[settled], count[settled], np.zeros(int(settled.sum()), bool))
            anchor, stretch, doc, start, count = (x[~settled] for x in (anchor, stretch, doc, start, count))
        if not len(anchor):
            continue
        if last:  # the open group leads; its first row is repeated in front
            anchor, stretch, doc, start, count = (np.concatenate(([a], b)) for a, b in zip(last[:5], (anchor, stretch, doc, start, count), strict=True))
        same_anchor = np.concatenate(([False], anchor[1:] == anchor[:-1]))
        same = same_anchor & np.concatenate(([False], stretch[1:] == stretch[:-1]))
        heads = np.flatnonzero(~same)
        head = heads[np.cumsum(~same) - 1]
        mark = same & ((doc != doc[head]) | (start != start[head]))
        several = np.zeros(len(heads), bool)  # this stretch's anchor has another one
        linked = anchor[heads[1:]] == anchor[heads[:-1]]
        several[1:] |= linked
        several[:-1] |= linked
        sent = bool(last and last[5])
        if sent:
            several[0] = True
        extend = heads[several]
        if sent:
            extend = extend[extend > 0]
        yield out(np.concatenate((doc[mark], doc[extend])), np.concatenate((start[mark], start[extend])), np.concatenate((count[mark], count[extend])), np.concatenate((np.zeros(int(mark.sum()), bool), np.ones(len(extend), bool))))
        h = heads[-1]
        last = (anchor[h], stretch[h], doc[h], start[h], count[h], bool(several[-1]))


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"))
                hashes = word_hashes(words)
                if len(hashes) < window:
                    continue
                runs = part.column("runs")
                flat = runs.flatten()
                row = np.repeat(np.arange(part.num_rows), runs.value_lengths().fill_null(0).to_numpy())
                start, count = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
                each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start, row = np.repeat(start, count) + each, np.repeat(row, count)
                at = words.of[row] + start
                fits = at + window <= words.of[row + 1]  # else a row of another text with this id
                start, row, at = start[fits], row[fits], at[fits]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                one, two = gram_hashes(hashes, window), gram_hashes(hashes, window, 0xE7037ED1A0B428DB)
                yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(ids[row]), pa.array(start.astype(np.int32))], ["one", "two", "doc_id", "start"])

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"))
                runs = part.column("runs")
                flat = runs.flatten()
                gone = np.zeros(len(words.starts) + 1, np.int32)
                if len(flat):
                    row = np.repeat(np.arange(part.num_rows), runs.value_lengths().fill_null(0).to_numpy())
                    begin = words.of[row] + flat.field("start").to_numpy()
                    end = np.minimum(begin + flat.field("windows").to_numpy() - 1 + window, words.of[row + 1])
                    begin = np.minimum(begin, end)
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, end, -1)
                keep = np.cumsum(gone[:-1]) == 0
                data, texts, removed = words.data.tobytes(), [], []
                for d in range(part.num_rows):
                    lo, hi = words.of[d], words.of[d + 1]
                    own = np.flatnonzero(keep[lo:hi]) + lo
                    removed.append(int(hi - lo - len(own)))
                    texts.append(b" ".join(data[s:e] for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.of)), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), (pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(texts), pa.string()))],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, windows): runs of windows of a document whose words also start earlier; start counts words from 0.

    Earlier means in a document of smaller id, or before it in the same document. Texts with fewer words than the window have no rows.
    """
    require_whole_ids(docs, id_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeds = texts.mapInArrow(_seeds(window, min(GRAM, window)), _ANCHORS)
    matched = seeds.repartition("key").sortWithinPartitions("anchor", "stretch", "doc_id", "start").mapInArrow(_match, "doc_id long, start int, windows int, extend boolean")
    matched = written(matched, "repeats")
    runs = matched.where("extend").groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    windows = texts.join(runs.hint("shuffle_hash"), "doc_id").mapInArrow(_extend(window), "one long, two long, doc_id long, start int")
    # Of equal windows the first stays: min() combines before the shuffle, the join's hot keys are split by AQE.
    firsts = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("final")).where("first <> final").drop("final")
    later = windows.join(firsts, ["one", "two"]).where(F.struct("doc_id", "start") > F.col("first"))
    return matched.where("not extend").select("doc_id", "start", "windows").unionAll(later.select("doc_id", "start", F.lit(1).alias("windows")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Each document without the words of windows that also start earlier: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless with_text).

    Kept words are joined by one space. Null and empty texts have no words. A null id counts as the smallest one and comes back as null;
    ids that aren't whole numbers raise. An empty table gives no rows.
    Rows that share an id are versions of one document: the same place in them is one occurrence. Other columns play no part.
    """
    require_whole_ids(docs, id_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = repeats(docs, id_col, text_col, window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    whole = texts.join(runs.hint("shuffle_hash"), "doc_id", "left")
    out = whole.mapInArrow(_kept(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))
