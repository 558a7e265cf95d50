"""Spelling variants against all pairs of a small table."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayscope.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(w, alphabet):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
    return (out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}) - {w}


def plain(n):
    alphabet = sorted({c for w in n for c in w})
    near = {w: sorted(edits(w, alphabet) & n.keys()) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def table(n):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in n.collect()}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = ["Letterbox", "spelling", "ÉTÉmorning", "straßenbahn", "aaaaaaaa", "abababab", "windowpane", "ÿÿÿÿÿÿÿÀ", "x" * 300, "mornings"]
    words = []
    for w in base:
        words += [w] * 400
        for _ in range(60):
            v = w
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(v))
                v = rnd.choice([v[:i] + v[i + 1 :], v[:i] + rnd.choice("abeéßz") + v[i:], v[:i] + rnd.choice("abeéßz") + v[i + 1 :]])
            words += [v] * rnd.choice([1, 2, 3, 5, 30, 39, 40])
    rnd.shuffle(words)
    cut = [words[i : i + 97] for i in range(0, len(words), 97)]
    return [(i, rnd.choice([" ", ", ", "\n", "1", "漢"]).join(c)) for i, c in enumerate(cut)] + [(None, "Letterbox letterbox"), (5000, None), (5001, ""), (3, "windowpane"), (3, "windowpane")]


def test_against_all_edits(spark, texts):
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    want = plain(plain_words(texts))
    assert len(want) > 200 and sum(x[0] is not None and x[0] != x[1] for x in want.values()) > 0
    assert table(spelling.variants(docs)) == want


def test_small_cells_blocks_and_leaves(spark, texts, monkeypatch):
    """Many cells, cells cut into blocks, and leaves searched by halves give the same rows."""
    for name, value in (("CELL", 16), ("HELD", 5), ("LEAF", 3), ("HEAVY", 2), ("LONGEST", 40)):
        monkeypatch.setattr(spelling, name, value)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counted = spelling.words(docs).cache()
    got = {r.word: (r.form, r.n, r.n_near, r.form_n) for r in spelling.forms(counted).collect()}
    assert got == {w: (x[0], *x[2:]) for w, x in plain(plain_words(texts)).items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcéÿ", min_size=7, max_size=9), min_size=1, max_size=60, unique=True))
def test_pairs(own):
    for size in (7, 8, 9):
        points = [w for w in own if len(w) == size]
        if not points:
            continue
        cell = spelling.Cell(points, size)
        for shorter in (False, True):
            ask = [w for w in own if len(w) == size - shorter]
            if ask:
                got = {(ask[i], points[j]) for i, j in zip(*(x.tolist() for x in cell.near(ask, shorter)), strict=True)}
                assert got == {(a, b) for a in ask for b in points if b in edits(a, "abcéÿ")}


def test_boxes_hold_every_range():
    rnd = np.random.default_rng(3)
    counts = rnd.integers(0, 4, (500, spelling._LETTERS)).astype(np.int32)
    tree = spelling.grow(counts, 8)
    leaf_of = {int(m): leaf.number for leaf, _ in spelling.reached(tree, counts, np.full(500, 99, np.int32), np.full(500, 99, np.int32)) for m in leaf.members}
    moved = counts.copy()
    up, down = rnd.integers(0, spelling._LETTERS, 500), rnd.integers(0, spelling._LETTERS, 500)
    moved[np.arange(500), up] += 1
    moved[np.arange(500), down] -= 1
    one = np.ones(500, np.int32)
    seen = {(int(i), leaf.number) for leaf, some in spelling.reached(tree, moved, one, one) for i in some}
    assert all((i, leaf_of[i]) in seen for i in range(500)) and len(seen) < 500 * len(set(leaf_of.values())) / 2


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0 and spelling.variants(spark.createDataFrame([("a", "short words only")], "doc_id string, text string")).count() == 0
