"""Words of whole texts as flat numpy arrays, for code that runs on Arrow batches in Python workers.

A word is a run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r), unchanged; a null text has none.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240229)
_OF_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def worker_object(key: str = "", make: Callable[[], Any] | None = None) -> Any:
    """What make() gives, kept by this worker process over tasks until another key is asked for; without a key, what is kept goes."""
    kept = sys.modules.setdefault("_wayscope_worker", types.ModuleType("_wayscope_worker"))
    if getattr(kept, "key", "") != key:
        kept.key, kept.value = key, None
        pa.default_memory_pool().release_unused()
        kept.value = make() if make else None
    return getattr(kept, "value", None)


def power_table(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Of a chunk of documents: data (bytes of all texts), starts and ends of the words there, and of[d]:of[d+1] the words of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one more entry for the end); null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about most_bytes of text each, so that work arrays stay small whatever the batch holds."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words_of(texts: pa.Array) -> Words:
    data, at = text_bytes(texts)
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    is_word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # between the bytes i-1 and i lies a border
    edge[0] = edge[-1] = True
    edge[at] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~is_word[:-1]
    after[:-1] |= ~is_word[1:]
    starts, ends = np.flatnonzero(is_word & before), np.flatnonzero(is_word & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def word_hashes(words: Words) -> np.ndarray:
    """64 bits for each word, a function of its bytes alone."""
    data, starts, ends, _ = words
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(offset[-1] + sizes[-1]) - np.repeat(offset, sizes)
    parts = _OF_BYTE[data[within + np.repeat(starts, sizes)]] * power_table(int(sizes.max()), int(_BASE))[within]
    return mixed(np.add.reduceat(parts, offset) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, n: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """64 bits for each n consecutive words; grams that cross documents are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total = total * np.uint64(base) + hashes[i : i + size]
    return mixed(total)
