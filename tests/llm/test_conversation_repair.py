"""Repairs against a search through all edits."""

import random
import re
import zlib
from functools import cache
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayscope.llm import conversation_repair as cr

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def search(rows):
    """Least (cost, audit) and what is left, rows being (role, text, gone, short)."""

    @cache
    def best(i, q, inserted):
        ways = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if inserted < 3:
            for x in "ua":
                if (q, x) in STEP:
                    c, a, out = best(i, STEP[q, x], inserted + 1)
                    ways.append((c + 3, "I" + a, ((FULL[x], ""), *out)))
        if i < len(rows):
            role, text, gone, short = rows[i]
            c, a, out = best(i + 1, q, 0)
            ways.append((c + 4, "D" + a, out))
            if not gone:
                for edit, x, said, price in [("K", role[:1], role, 0), *(("R", x, FULL[x], 3) for x in "ua")]:
                    if (q, x) in STEP:
                        c, a, out = best(i + 1, STEP[q, x], 0)
                        ways.append((c + price + 3 * short, edit + a, ((said, text), *out)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # so that no call goes deep
        for q in range(4):
            best(i, q, 0)
    return best(0, 0, 0)


def plain(table):
    convs = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        counts, seen, rows, turns = [0] * 4, set(), [], [t for t, *_ in own if t is not None]
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            rows.append((role, text, fault in (0, 1), fault == 2))
        counts[3] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, left = search(tuple(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(), left)
    return out


KIND = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.booleans(), st.booleans()).map(lambda k: (k[0], k[1], k[2] and not k[1]))


@settings(max_examples=400, deadline=None)
@given(st.lists(KIND, max_size=8))
def test_auction_against_search(kinds):
    cost, audit, _ = search(tuple((k, "", gone, short) for k, gone, short in kinds))
    net = cr.Lattice(kinds)
    left = cr.applied(audit, [k[0] for k in kinds], [""] * len(kinds))
    assert net.edits((0,)) == [(audit, 3 if left else 0)] and net.cost(0) == cost


@settings(max_examples=200, deadline=None)
@given(st.lists(KIND, min_size=1, max_size=9), st.integers(1, 4))
def test_pieces_give_the_whole(kinds, size):
    """Cut anywhere, pieces priced from behind and entered in order give the edits of the whole."""
    parts = [kinds[i : i + size] for i in range(0, len(kinds), size)]
    ends = [cr._FINAL]
    for part in reversed(parts):
        costs = [[cr.Lattice(part, tuple(0 if x == q else cr._NONE for x in range(4))).cost(s) for q in range(4)] for s in range(4)]
        ends.insert(0, tuple(min(cr._NONE, min(costs[s][q] + ends[0][q] for q in range(4))) for s in range(4)))
    audit, state = "", 0
    for n, part in enumerate(parts):
        more, state = cr.Lattice(part, ends[n + 1], n == len(parts) - 1).edits((0, 1, 2, 3))[state]
        audit += more
    assert audit == cr.Lattice(kinds).edits((0,))[0][0] and ends[0][0] == cr.Lattice(kinds).cost(0)


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(8)
    said = ["One.", "Two!", "three", "", "  \n", "Four?  ", None, "x" * 3000 + ".", "Good. Day"]
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else "user" if t % 2 else "assistant", f"{rnd.random()}.") for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(c, rnd.choice([None, *range(6)]), role(), rnd.choice(said)) for c in range(60, 120) for _ in range(rnd.randint(1, 7))]
    rows += [(200, t, role(), rnd.choice(said)) for t in range(90)] + [(None, t, "user", "Hm.") for t in range(4)]
    rows += [(1000 + c, 0, "user", "Gone?") for c in range(60)]  # some lose their only row
    rnd.shuffle(rows)
    return rows


def results(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("piece", [32, 2])
def test_table(spark, table, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rows = cr.damaged(spark.createDataFrame([(*r, "kept", 1) for r in table], "conv_id long, turn long, role string, text string, audit string, place int"))
    want = plain(table)
    got = results(cr.repair(rows))
    assert got == {c: w[:-1] for c, w in want.items()}
    assert any(w[6] == "" for w in want.values())
    left = {}
    for r in sorted(cr.repaired_rows(rows).collect(), key=lambda r: r.place):
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {c: list(w[-1]) for c, w in want.items() if w[-1]}


def test_many_tasks_for_one_conversation(spark, monkeypatch):
    """One conversation holds nearly all rows, and texts repeat: its pieces lie in several tasks."""
    monkeypatch.setattr(cr, "PIECE", 5)
    table = [(7, t, "user" if t % 2 else "assistant", f"{t // 3 if t % 7 else 'same'}.") for t in range(300)] + [(8, t, "user", "So.") for t in range(3)]
    rows = cr.damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(6))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert results(cr.repair(rows)) == {c: w[:-1] for c, w in plain(table).items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_text_ids_and_empty_tables(spark):
    text = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("é", None, None, None)], "conv_id string, turn int, role string, text string")
    assert {r.conv_id for r in cr.repair(cr.damaged(text)).collect()} == {"a", "é"}
    assert cr.repair(cr.damaged(text.limit(0))).count() == 0 and cr.repaired_rows(cr.damaged(text.limit(0))).count() == 0
