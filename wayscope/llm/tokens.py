"""Token ids of whole texts in Python workers, a word at a time.

The tokenizer lets no token cross white space, so a text's ids are those of its words; each different word is encoded once
and kept by the worker, up to a bound.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import worker_object

_ENDS = (".", ",")


class WordEncoder:
    """Ids of words by the tokenizer at path. At most about most_words different ones are kept, as Arrow strings and numpy arrays of some 30
    bytes a word; beyond that, those that were met in most batches stay."""

    def __init__(self, path: str, most_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.last = np.array([(x or "").endswith("</w>") for x in names])  # ids that end a run of letters
        self.words = pa.array([], pa.large_string())
        # Of each word: where its ids begin in flat, their number, and how many batches met it.
        self.flat, self.begin, self.size, self.met = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int32, np.int32))
        self.stop = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in _ENDS}
        if any(len(x) != 1 for x in self.stop.values()):
            raise ValueError("a full stop and a comma should be one token each")

    def _thin(self) -> None:
        """Keep half as many words as may be kept, those met in most batches; what they were met in before counts half."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        size = self.size[stay]
        begin = np.cumsum(size, dtype=np.int64) - size
        at = np.arange(size.sum()) + np.repeat(self.begin[stay] - begin, size)
        self.words, self.flat, self.begin, self.size, self.met = self.words.take(pa.array(stay)), self.flat[at], begin, size, self.met[stay] // 2

    def _encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """Arrays of ids and of words' numbers of ids, and the words' places in that order. Words of letters go through the tokenizer side by
        side, which is faster: each has one id that ends it, or they go one by one."""
        flat, size, order, rest = [], [], [], []
        letters: list[int] = []
        for i, w in enumerate(words):
            (letters if w.isalpha() else rest).append(i)
        groups = [letters[i : i + 100] for i in range(0, len(letters), 100)]
        texts = [" ".join([words[i] for i in g]) for g in groups]
        for group, x in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                flat.append(ids)
                size.append(np.diff(ends, prepend=0))
                order += group
            else:
                rest += group
        single = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        flat.append(np.fromiter(itertools.chain.from_iterable(single), np.uint32))
        size.append(np.fromiter(map(len, single), np.int64, len(single)))
        return flat, size, order + rest

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The place of each of different words in begin and size."""
        if len(self.words) > self.most:
            self._thin()
        slot = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(slot.is_null())
        slot = slot.fill_null(0).to_numpy(zero_copy_only=False).copy()
        if len(new):
            lacking = words.take(pa.array(new))
            flat, size, order = self._encode(lacking.to_pylist())
            size = np.concatenate(size).astype(np.int32)
            slot[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, lacking.take(pa.array(order)).cast(pa.large_string())])
            self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size, dtype=np.int64) - size))
            self.size = np.concatenate((self.size, size))
            self.met = np.concatenate((self.met, np.zeros(len(size), np.int32)))
            self.flat = np.concatenate((self.flat, *flat))
        self.met[slot] += 1
        return slot

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, text after text, and where each text's begin (one more entry for the end); null counts as empty."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        of, each = words.offsets.to_numpy(), words.values.dictionary_encode()
        # ASCII letters and digits lose only their case to the tokenizer, and a full stop or comma after them is a token of its own.
        whole = each.dictionary
        stem = pc.replace_substring_regex(whole, "^([0-9A-Za-z]+)[.,]$", "\\1")
        plain = pc.if_else(pc.ascii_is_alnum(stem), pc.ascii_lower(stem), stem).dictionary_encode()
        end = np.zeros(len(whole), np.uint32)
        for x in _ENDS:
            end[pc.and_(pc.ends_with(whole, x), pc.not_equal(stem, whole)).to_numpy(zero_copy_only=False)] = self.stop[x][0]
        slot = self._slots(plain.dictionary)[plain.indices.to_numpy()]
        index = each.indices.to_numpy()
        size = self.size[slot] + (end > 0)
        counts = size[index]
        upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)))
        where = np.arange(upto[-1], dtype=np.int32) + np.repeat((self.begin[slot][index] - upto[:-1]).astype(np.int32), counts)
        ended = np.flatnonzero(end[index] > 0)
        where[upto[ended + 1] - 1] = 0
        out = self.flat[where] if len(self.flat) else np.zeros(len(where), np.uint32)
        out[upto[ended + 1] - 1] = end[index[ended]]
        return out, upto[of]


def encoder(path: str) -> WordEncoder:
    """One for each worker process, kept over tasks until the worker does other work."""
    return worker_object(f"encoder {path}", lambda: WordEncoder(path))
