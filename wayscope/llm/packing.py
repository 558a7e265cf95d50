"""Packing into windows of equal capacity by multiway differencing.

1. A document's ids are cut into pieces: full windows first, the rest into pieces of at most PIECE ids. Checksums are taken here, so
   only a piece's length moves on.
2. Pieces are dealt evenly to groups of bounded size; each group is packed by itself: the two partial partitions with the largest
   imbalance are merged, largest window of one with smallest of the other, until one is left. Windows come out nearly equal; where one
   exceeds the capacity, the group is packed again with more windows.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .tokens import encoder
from .words import chunks

CAPACITY = 4096
PIECE = 1024
GROUP = 6144
END_ID = 2


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Positions of sizes, in parts of nearly equal sums. A partial partition is a sorted list of (sum, order, tree of positions);
    those of its parts that aren't listed are empty."""
    order = itertools.count()
    heap = [(-size, i, [(size, next(order), i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    ties = itertools.count(len(sizes))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        over = max(0, len(a) + len(b) - parts)  # so many meet; the others of one meet empty parts of the other
        met = [(x[0] + y[0], next(order), (x[2], y[2])) for x, y in zip(a[:over], b[:over][::-1], strict=True)]
        del a[:over]
        for x in itertools.chain(b[over:], met):
            bisect.insort(a, x)
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == parts else 0)), next(ties), a))
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        todo, own = [tree], []
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                own.append(x)
        out.append(own)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of sizes (each at most capacity) by window; the number of windows rises until none exceeds the capacity."""
    parts = max(1, -(-sum(sizes) // capacity))
    while sizes:
        out = differencing(sizes, parts)
        excess = sum(max(0, sum(sizes[i] for i in own) - capacity) for own in out)
        if not excess:
            return out
        parts += -(-excess // capacity)
    return []


def _pieces(path: str, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                ids, at = own.ids(part.column("text"))
                row, start, size, crc = [], [], [], []
                for d in range(part.num_rows):
                    doc = np.append(ids[at[d] : at[d + 1]], np.uint32(END_ID)).astype("<u4")
                    s = 0
                    while s < len(doc):
                        n = capacity if len(doc) - s >= capacity else min(piece, len(doc) - s)
                        row.append(d)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(doc[s : s + n]))
                        s += n
                row = np.array(row, np.int64)
                tokens = np.diff(at)[row] + 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, size, crc, tokens))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _packed(capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        held, rows = [], 0

        def flush(held):
            nonlocal first
            table = pa.Table.from_batches(held).combine_chunks()
            size = table.column("length").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            full = np.flatnonzero(size == capacity)
            sequence[full] = np.arange(len(full))
            rest = np.flatnonzero(size < capacity)
            used = len(full)
            for own in windows(size[rest].tolist(), capacity):
                at = rest[np.sort(np.array(own))]
                sequence[at] = used
                offset[at] = np.cumsum(size[at]) - size[at]
                used += 1
            table = table.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
            first += used
            return table.to_batches()

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, group - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == group:
                    yield from flush(held)
                    held, rows = [], 0
        if held:
            yield from flush(held)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of the vocabulary, there on every executor. Each document ends with id 2, so null and empty texts are one id long.
    Rows that share an id or a text are packed one by one; an empty table gives no rows; other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = written(texts.mapInArrow(_pieces(tokenizer, capacity, piece), names), "pieces")
    groups = max(1, -(-pieces.count() // group))
    return pieces.repartition(groups).mapInArrow(_packed(capacity, group + group // 4), names + ", sequence_id long, offset long")
