"""Merge-type (BPE) SentencePiece encoding of whole texts by backtracking, and decoding.

Of all ways to cut a text into pieces there is one in which every two neighbours are compatible: merging the text of both from its characters
gives these two again. The merges end in that one, so it is found without running them over the text: take the longest piece at each place
(Aho-Corasick, one pass), go to shorter ones while a neighbour is not compatible, step back where none is left, and never try a place again
from which the text's rest failed (a bit per place). What a pair's merges give is kept, so most checks are a look-up.

No piece crosses two neighbouring characters that stand side by side in no piece. Texts are cut there first, exactly, and each different
stretch between two cuts is encoded once while the worker keeps it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, worker_object

SPACE = "▁"
#: Numbers from here on stand for single characters that are no piece.
_CHARACTER = 1 << 24
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file


class Pieces:
    """The pieces of a merge-type model at path, what was learnt about pairs of them (at most about most_pairs) and the ids of stretches met
    lately (at most about most_stretches; those not met for that long go)."""

    def __init__(self, path: str, most_stretches: int = 800_000, most_pairs: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2 as model

        m = model.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != m.trainer_spec.BPE:
            raise ValueError(f"not a merge-type model: {path}")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"a model that rewrites texts before encoding is not supported: {path}")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in m.pieces):
            raise ValueError(f"user-defined and unused pieces are not supported: {path}")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.most_stretches, self.most_pairs = most_stretches, most_pairs
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE} if m.trainer_spec.byte_fallback else {}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        # Pieces that merging never ends in are not in the automaton; a single character always stands.
        own = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        inside = set(own)
        self.text = {self.id[p]: p for p in own}
        self.shorter: dict[int, int] = {}
        for p in own:
            if len(p) > 1:
                less = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in inside), None)
                self.shorter[self.id[p]] = self.id[less] if less else _CHARACTER + ord(p[0])
        self.automaton = ahocorasick.Automaton()
        for p in own:
            self.automaton.add_word(p[::-1], self.id[p])
        self.automaton.make_automaton()
        self.gap = next(chr(c) for c in range(0x110000) if not any(chr(c) in p for p in self.score))
        # Which characters stand side by side in any piece.
        several = [p for p in self.score if len(p) > 1]
        letters = sorted({c for p in several for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in several:
            k = self.kind[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True
        # What each id stands for when decoded.
        out = [p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        for i, p in enumerate(m.pieces):
            if p.type == CONTROL:
                out[i] = b""
            elif p.type == UNKNOWN:
                out[i] = m.trainer_spec.unk_surface.encode()
            elif p.type == BYTE:
                out[i] = bytes([int(p.piece[3:5], 16)])
        self.surface = pa.array(out, pa.large_binary())
        self.is_byte, self.is_control = (np.array([p.type == k for p in m.pieces]) for k in (BYTE, CONTROL))
        self.opens = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in m.pieces])
        self.decimal = pa.array([b"%d," % i for i in range(len(m.pieces))], pa.large_binary())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging ends in: of neighbours that make a piece together, the pair of best score first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        joint = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, s in enumerate(joint):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at > 0:
                joint[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(joint):
                joint[at] = score.get(parts[at] + parts[at + 1])

    def _text(self, number: int) -> str:
        return chr(number - _CHARACTER) if number >= _CHARACTER else self.text[number]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self._text(a), self._text(b)
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(left + right) == [left, right]
        return known

    def _backtracked(self, first: list[int], at: int, n: int) -> list[int]:
        """Pieces of the n characters from place at; first: the longest piece at each place."""
        failed = bytearray(n // 8 + 1)  # bit i: no way to the end from place i
        taken: list[int] = []
        pos, number = 0, first[at]
        text, shorter, pairs = self.text, self.shorter, self.pairs
        while pos < n:
            end = pos + (1 if number >= _CHARACTER else len(text[number]))
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = not taken or pairs.get((taken[-1], number))
                if fits is None:
                    fits = self.compatible(taken[-1], number)
                if fits:
                    taken.append(number)
                    pos = end
                    number = first[at + pos] if pos < n else 0
                    continue
            less = shorter.get(number)
            while less is None:  # nothing shorter: this place fails after any piece that ends here
                failed[pos >> 3] |= 1 << (pos & 7)
                number = taken.pop()
                pos -= 1 if number >= _CHARACTER else len(text[number])
                less = shorter.get(number)
            number = less
        return taken

    def _encoded(self, stretches: list[str]) -> list[bytes]:
        """Ids of each of several stretches, as the bytes of 32-bit numbers."""
        whole = self.gap.join(stretches)
        first = [_CHARACTER + ord(c) for c in whole]
        last = len(whole) - 1
        for end, number in self.automaton.iter(whole[::-1]):  # of pieces that begin at one place, the longest comes first
            if first[last - end] >= _CHARACTER:
                first[last - end] = number
        out, at = [], 0
        for s in stretches:
            ids: list[int] = []
            for x in self._backtracked(first, at, len(s)):
                if x < _CHARACTER:
                    ids.append(x)
                else:
                    ids += [self.bytes[b] for b in chr(x - _CHARACTER).encode()] if self.bytes else [self.unknown]
            # Without fallback to bytes, neighbouring unknown characters are one unknown piece.
            out.append(np.array(ids, np.uint32).tobytes())
            at += len(s) + 1
        return out

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """text between cuts, some hundred thousand stretches at a time."""
        cuts, step = [np.zeros(1, np.int64)], 1 << 20
        for a in range(0, len(text), step):
            k = self.kind[np.frombuffer(text[a : a + step + 1].encode("utf-32-le"), np.uint32)]
            cuts.append(np.flatnonzero(~self.beside[k[:-1], k[1:]]) + a + 1)
        edge = np.concatenate([*cuts, [len(text)]])
        for a in range(0, len(edge) - 1, 200_000):
            e = edge[a : a + 200_001].tolist()
            yield [text[i:j] for i, j in zip(e, e[1:], strict=False)]

    def encode(self, text: str) -> np.ndarray:
        """All ids of a whole text, without begin or end."""
        if not text:
            return np.zeros(0, np.uint32)
        parts = []
        for own in self._stretches(self.prefix + text.replace(" ", SPACE)):
            lacking = []
            for s in set(own):
                if s not in self.young:
                    known = self.old.get(s)
                    if known is None:
                        lacking.append(s)
                    else:
                        self.young[s] = known
            if lacking:
                self.young.update(zip(lacking, self._encoded(lacking), strict=True))
            parts.append(np.frombuffer(b"".join(map(self.young.__getitem__, own)), np.uint32))
            if len(self.young) > self.most_stretches // 2:
                self.old, self.young = self.young, {}
        ids = np.concatenate(parts)
        if self.bytes:
            return ids
        return ids[~((ids == self.unknown) & np.concatenate(([False], ids[:-1] == self.unknown)))]

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for. Ids of bytes that make no UTF-8 become U+FFFD, one for each byte that has no place in a character."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        own = ids
        start = 0
        if self.prefix:  # the space put before the text goes again, with the first piece that isn't a control one
            seen = np.flatnonzero(~self.is_control[ids])
            if len(seen) and self.opens[ids[seen[0]]]:
                own, start = ids[seen[0] :], 1
        raw = self.surface.take(pa.array(own))
        _, offsets, data = raw.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(own) + 1]
        flat = data.to_pybytes()[: at[-1]] if data is not None else b""
        try:
            return flat[start:].decode()
        except UnicodeDecodeError:
            pass
        # Runs of byte pieces are decoded on their own, so that they can't join with what is beside them.
        out, is_byte = [], self.is_byte[own]
        edge = [0, *(np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1).tolist(), len(own)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = flat[at[a] if a else start : at[b]]
            out.append(_lenient(part) if is_byte[a] else part.decode())
        return "".join(out)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Ids as decimal numbers with commas between."""
        if not len(ids):
            return b""
        _, _, data = self.decimal.take(pa.array(ids)).buffers()
        return data.to_pybytes().rstrip(b"\0")[:-1]


_CHAR = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte outside a well-formed character."""
    out, at = [], 0
    while at < len(raw):
        m = _CHAR.match(raw, at)
        out.append(m[0].decode() if m else "�")
        at = m.end() if m else at + 1
    return "".join(out)


def pieces(path: str) -> Pieces:
    """One for each worker process, kept over tasks until the worker does other work."""
    return worker_object(f"pieces {path}", lambda: Pieces(path))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts, texts.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of each row, over its whole text, by the model at that path on every executor; one narrow pass, no shuffle.

    Null and empty texts have no ids; rows with the same id or text are encoded one by one; other columns play no part; an empty table gives
    no rows. A text of any length is one row: its ids are held as 4 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                at = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null and empty lists give empty texts, nulls within a list are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = [own.decode(np.array([x for x in ids or () if x is not None], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    lists = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the text decoded from those ids) of each row, without
    moving the ids themselves; rows are treated as encode() treats them."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in chunks(batch, "text"):
                n, coded, back = [], [], []
                for text in part.column("text").to_pylist():
                    ids = own.encode(text or "")
                    n.append(len(ids))
                    coded.append(sha256(own.decimals(ids)).hexdigest())
                    back.append(sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
