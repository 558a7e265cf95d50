"""Repair of conversations' structure at least cost, by the auction algorithm for shortest paths.

A conversation's rows in order, together with what role may come next, span a lattice: node (i, q) stands before row i in state q of the automaton
of `(s?(ua)+)?`. Arcs are edits: Delete, Insert, Keep, Rerole, each with a whole cost and, out of one node, each to one node. The auction keeps
a price for every node, never above an arc's cost plus the price at its other end, and a path from the start. It lengthens the path along an
arc of least cost plus price, or, where that exceeds the node's own price, raises the price and takes the path back by one. When the path
arrives, the start's price is the least cost, and every cheapest path runs along tight arcs only (price = cost + price behind). Of these the
least in order of letters is traced.

Rows are sorted over all tasks by range, so one conversation may span many tasks. What lies whole within one is repaired there. Others are cut
into pieces of at most PIECE rows: costs between the states at both ends of each piece (piece by piece), the least cost from each piece's end
(one pass backwards over small rows), the edits from each state (piece by piece), and the state that each piece is entered in (one pass forwards).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, workspace, written

PIECE, PIECE_CHARS = 32, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"
_NONE = 1 << 60
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What Insert and Rerole give next, and what Keep makes of each role's initial.
_NEXT = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ROLE = {2: "user", 3: "assistant"}
_FINAL = (0, _NONE, _NONE, 0)
_KINDS: dict[tuple[str, bool, bool], list[list[tuple[str, int, int]]]] = {}


def _arcs(kind: tuple[str, bool, bool]) -> list[list[tuple[str, int, int]]]:
    """Of a row (initial of its role, whether it must go, whether it is cut short): from each state, (edit, cost, state after), in order of edits."""
    own = _KINDS.get(kind)
    if own is None:
        initial, gone, short = kind
        more = TRUNCATED if short else 0
        own = []
        for q in range(4):
            arcs = [("D", DELETE, q)]
            if not gone:
                if q in _KEPT.get(initial, ()):
                    arcs.append(("K", KEEP + more, _KEPT[initial][q]))
                arcs.append(("R", REROLE + more, _NEXT[q]))
            own.append(arcs)
        _KINDS[kind] = own
    return own


class Lattice:
    """Rows as kinds, and what it costs to end in each state. Node 4 i + q; the last node is the end. Where other rows follow, what is inserted
    between is left to them (last: whether none do), so that the edits of all pieces together are in order of letters too."""

    def __init__(self, kinds: list[tuple[str, bool, bool]], ends: tuple[int, ...] = _FINAL, last: bool = True):
        m = len(kinds)
        self.end = 4 * m + 4
        self.out: list[list[tuple[str, int, int]]] = []
        for i in range(m + 1):
            rows = _arcs(kinds[i]) if i < m else None
            for q in range(4):
                arcs = [(e, c, 4 * i + 4 + to) for e, c, to in rows[q]] if rows else []
                if rows or last:
                    arcs.insert(1 if rows else 0, ("I", INSERT, 4 * i + _NEXT[q]))
                if not rows and ends[q] < _NONE:
                    arcs.append(("", ends[q], self.end))
                self.out.append(arcs)
        self.open = self._leading(lambda node, arc: True)
        self.out = [[arc for arc in arcs if self.open[arc[2]]] for arcs in self.out]
        # No row costs less than its cheapest edit, so these prices are below every arc's cost plus price from the start.
        least = [0] * (m + 1)
        for i in range(m - 1, -1, -1):
            initial, gone, short = kinds[i]
            least[i] = least[i + 1] + (DELETE if gone else TRUNCATED if short else 0)
        base = min(ends)
        self.price = [base + least[node // 4] for node in range(4 * m + 4)] + [0]

    def _leading(self, takes: Any) -> list[bool]:
        """Nodes from which arcs that takes(node, arc) says yes to lead to the end."""
        leads = [False] * self.end + [True]
        for first in range(self.end - 4, -1, -4):
            for _ in range(3):  # inserts stay within the four nodes of one place
                for node in range(first, first + 4):
                    leads[node] = leads[node] or any(leads[arc[2]] and takes(node, arc) for arc in self.out[node])
        return leads

    def cost(self, start: int) -> int:
        """Least cost from state start before the first row; _NONE if there is no way."""
        if not self.open[start]:
            return _NONE
        price, out, path = self.price, self.out, [start]
        while True:
            node = path[-1]
            best, to = _NONE, -1
            for _, cost, other in out[node]:
                x = cost + price[other]
                if x < best:
                    best, to = x, other
            if price[node] < best:  # contraction
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to == self.end:
                return price[start]
            else:
                path.append(to)  # extension

    def edits(self, starts: tuple[int, ...]) -> list[tuple[str, int] | None]:
        """From each state of starts: the cheapest edits, of several the least in order, and the state they end in; None where there is no way."""
        reachable = [self.cost(s) < _NONE for s in starts]
        price = self.price
        leads = self._leading(lambda node, arc: price[node] == arc[1] + price[arc[2]])
        found: list[tuple[str, int] | None] = []
        for s, way in zip(starts, reachable, strict=True):
            if not way:
                found.append(None)
                continue
            node, last, done = s, s, []
            while node != self.end:
                last = node
                edit, _, node = next(arc for arc in self.out[node] if price[node] == arc[1] + price[arc[2]] and leads[arc[2]])
                done.append(edit)
            found.append(("".join(done), last % 4))
        return found


def applied(audit: str, roles: list[str], texts: list[str], state: int = 0) -> list[tuple[str, str]]:
    """(role, text) of each row that edits leave, from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], ""))
            continue
        if edit == "K":
            state = _KEPT[roles[i][:1]][state]
            out.append((roles[i], texts[i]))
        elif edit == "R":
            state = _NEXT[state]
            out.append((_ROLE[state], texts[i]))
        i += 1
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of each row, after damage by a hash of conv_id and turn; nulls count as one space, but a null turn stays
    null. copies is 0 for rows that the damage drops and 2 for those it repeats."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(h <= 1, "").when(h == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.when(h == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """rows with what each one's faults are but for rows alike in all columns, which lie side by side; by conversation and turn, over all tasks."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    own = rows.select(
        "conv_id", F.col("turn").isNotNull().alias("known"), "turn", "role", F.sha2("text", 256).alias("sha"), "text", "copies",
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("short"),
    )
    key = ["conv_id", "role", "sha"]
    # Texts that come at several turns of a conversation: few, and joined by a key of which the other side may hold many.
    again = own.where("copies > 0").groupBy(*key).agg(F.min(F.struct("known", "turn")).alias("first"), F.max(F.struct("known", "turn")).alias("last")).where("not first <=> last")
    again = again.select(*(F.col(c).alias(f"{c}_") for c in key), "first")
    met = own.join(again, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("sha") == F.col("sha_")), "left")
    late = F.coalesce(F.struct("known", "turn") > F.col("first"), F.lit(False))
    order = ["conv_id", "known", "turn", "role", "sha"]
    return met.select(*order, "text", "copies", "blank", "short", late.alias("late")).repartitionByRange(*order).sortWithinPartitions(*order)


_FIGURES = ("blank", "duplicate", "truncated", "illegal")
_PIECE_TYPE = (
    "whole boolean, place long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "initials string, gone array<boolean>, short array<boolean>, roles array<string>, texts array<string>, cost long, audit string, sha string"
)
_LEGAL = {"su", "ua", "au"}


class _Piece:
    """Rows of one conversation that stand one after another, as they are gathered."""

    def __init__(self, conv: Any, place: int, before: str | None):
        self.conv, self.place, self.before = conv, place, before
        self.kinds: list[tuple[str, bool, bool]] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.figures = dict.fromkeys(_FIGURES, 0)
        self.turns, self.first, self.last, self.chars = 0, None, None, 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, short: bool) -> None:
        fault = "blank" if blank else "duplicate" if again else "truncated" if short else None
        if fault:
            self.figures[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.figures["illegal"] += 1
        self.before = initial
        self.kinds.append((initial, blank or again, fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn


_MOST_KNOWN = 100_000


def _gather(keep: bool):
    """Sorted rows to pieces. A conversation that begins and ends within the task, with at most PIECE rows, is repaired at once; keep: with its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        names, schema, known = [], None, {}
        done: list[tuple] = []
        held, first, seen, parts, waiting = None, True, None, False, 0

        def row(p: _Piece, whole: bool) -> tuple:
            cost = audit = sha = None
            if whole:
                at = tuple(p.kinds)
                if at not in known:
                    if len(known) >= _MOST_KNOWN:
                        known.clear()
                    net = Lattice(p.kinds)
                    audit, _ = net.edits((0,))[0]
                    known[at] = net.cost(0), audit
                cost, audit = known[at]
                sha = sha256("\n".join(f"{r}:{t}" for r, t in applied(audit, p.roles, p.texts)).encode()).hexdigest()
            rows = (p.roles, p.texts) if keep or not whole else (None, None)
            initials = "".join(k[0] or "\0" for k in p.kinds)
            return (p.conv, whole, p.place, *p.figures.values(), p.turns, p.first, p.last, initials, [k[1] for k in p.kinds], [k[2] for k in p.kinds], *rows, cost, audit, sha)

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            if schema is None:
                more = [pa.bool_(), *[pa.int64()] * 8, pa.string(), *[pa.list_(pa.bool_())] * 2, *[pa.list_(pa.string())] * 2, pa.int64(), pa.string(), pa.string()]
                schema, names = [batch.schema.field("conv_id").type, *more], ["conv_id", *(c.split()[0] for c in _PIECE_TYPE.split(", "))]
            for conv, _, turn, role, sha, text, copies, blank, short, late in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv != held.conv:
                    if held is not None:
                        # The first conversation of a task may have begun before it.
                        done.append(row(held, not parts and not first))
                        first = False
                    held, seen, parts = _Piece(conv, base | number, None), None, False
                    number += 1
                for _ in range(copies):
                    if len(held.kinds) >= PIECE or held.chars > PIECE_CHARS:
                        done.append(row(held, False))
                        held, parts = _Piece(conv, base | number, held.before), True
                        number += 1
                    here = (turn, role, sha)
                    held.add(turn, role, text, blank, late or here == seen, short)
                    seen = here
                waiting += len(text)
                if len(done) >= 512 or done and waiting > PIECE_CHARS:
                    yield out()
                    waiting = 0
        if held is not None:
            done.append(row(held, False))  # it may go on in the next task
        if done:
            yield out()

    return run


def _kinds(initials: str, gone: list[bool], short: list[bool]) -> list[tuple[str, bool, bool]]:
    return list(zip(("" if c == "\0" else c for c in initials), gone, short, strict=True))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, the least cost from each state before it to each state after it."""
    for batch in batches:
        out = []
        for initials, gone, short in zip(*(batch.column(c).to_pylist() for c in ("initials", "gone", "short")), strict=True):
            kinds, costs = _kinds(initials, gone, short), []
            for q in range(4):
                net = Lattice(kinds, tuple(0 if x == q else _NONE for x in range(4)))
                costs.append([net.cost(s) for s in range(4)])
            out.append([costs[q][s] for s in range(4) for q in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("place"), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "place", "costs"])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last one of each conversation: the least cost from each state after the piece. Four numbers are carried."""
    conv, ends, begun = None, _FINAL, False
    for batch in batches:
        out, last = [], []
        for own, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            last.append(not begun or own != conv)
            if last[-1]:
                conv, ends, begun = own, _FINAL, True
            out.append(list(ends))
            ends = tuple(min(_NONE, min(costs[4 * s + q] + ends[q] for q in range(4))) for s in range(4))
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.list_(pa.int64())), pa.array(last, pa.bool_())], ["place", "ends", "last"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece and each state before it: the cheapest edits, and the state after them."""
    for batch in batches:
        audits, states = [], []
        for initials, gone, short, ends, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "gone", "short", "ends", "last")), strict=True):
            found = Lattice(_kinds(initials, gone, short), tuple(ends), last).edits((0, 1, 2, 3))
            audits.append([f[0] if f else None for f in found])
            states.append([f[1] if f else None for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("place"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], ["conv_id", "place", "audits", "states"])


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: the state that each is entered in, and its edits from there. One state is carried."""
    conv, state, begun = None, 0, False
    for batch in batches:
        edits, entered = [], []
        for own, audits, states in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audits", "states")), strict=True):
            if not begun or own != conv:
                conv, state, begun = own, 0, True
            edits.append(audits[state])
            entered.append(state)
            state = states[state]
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(edits, pa.string()), pa.array(entered, pa.int32())], ["place", "edits", "state"])


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits, in order, to a row for each conversation; texts are hashed as they pass."""
    conv, begun, names, kind = None, False, ["conv_id", *(c.split()[0] for c in _RESULT.split(", "))], None
    figures, audit, digest, lines = [0] * 4, [], sha256(), 0
    turns, low, high, cost, before = 0, None, None, 0, None

    def out() -> pa.RecordBatch:
        gaps = high - low + 1 - turns if turns else 0
        values = [conv, gaps, *figures, cost, "".join(audit), digest.hexdigest()]
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                if begun:
                    yield out()
                conv, begun = r["conv_id"], True
                figures, audit, digest, lines = [0] * 4, [], sha256(), 0
                turns, low, high, cost, before = 0, None, None, 0, None
            kinds = _kinds(r["initials"], r["gone"], r["short"])
            figures = [a + r[k] for a, k in zip(figures, _FIGURES, strict=True)]
            # Where a task ended within the conversation, its pieces don't know the row before.
            if before is not None and kinds and r["joint"] and before + kinds[0][0] not in _LEGAL:
                figures[3] += 1
            before = kinds[-1][0] if kinds else before
            turns += r["turns"] - (r["first_turn"] is not None and r["first_turn"] == high)
            low, high = r["first_turn"] if low is None else low, high if r["last_turn"] is None else r["last_turn"]
            audit.append(r["edits"])
            cost += _spent(r["edits"], kinds)
            for role, text in applied(r["edits"], r["roles"], r["texts"], r["state"]):
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
    if begun:
        yield out()


def _spent(audit: str, kinds: list[tuple[str, bool, bool]]) -> int:
    rows = iter(kinds)
    return sum(INSERT if e == "I" else {"D": DELETE, "K": KEEP + TRUNCATED * k[2], "R": REROLE + TRUNCATED * k[2]}[e] for e in audit for k in [None if e == "I" else next(rows)])


def _pieces(rows: DataFrame, keep: bool, at: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of rows (see damaged()): those that are whole conversations, and the others with edits and the state they are entered in."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = written(_sorted_rows(rows).mapInArrow(_gather(keep), f"conv_id {kind}, {_PIECE_TYPE}"), "pieces", at)
    parts = pieces.where("not whole").drop("cost", "audit", "sha")
    lattice = parts.select("conv_id", "place", "initials", "gone", "short")
    costs = lattice.mapInArrow(_costs, f"conv_id {kind}, place long, costs array<bigint>").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"))
    ends = costs.mapInArrow(_backwards, "place long, ends array<bigint>, last boolean")
    chosen = lattice.join(ends, "place").select("conv_id", "place", "initials", "gone", "short", "ends", "last").mapInArrow(_choices, f"conv_id {kind}, place long, audits array<string>, states array<int>")
    edits = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_forwards, "place long, edits string, state int")
    return pieces.where("whole"), parts.join(written(edits, "edits", at), "place")


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of rows (conv_id, turn, role, text, copies; see damaged()): gaps in turns, rows that are blank, duplicate or truncated (the
    first of these that holds), neighbours whose roles may not follow, the least cost of edits, these edits (audit) and a hash of the repaired
    rows.

    Rows are in order of turn (nulls first), then of role and of the text's hash, and of rows alike in all of that all but one are duplicates. A null
    conv_id is a conversation like any other. A conversation without rows has zeros, an empty audit and the hash of the empty string; empty
    tables give no rows. Other columns play no part. A conversation of any length is held a piece at a time.
    """
    at = workspace(rows.sparkSession, "repair")
    whole, parts = _pieces(rows, False, at)
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    one = whole.select("conv_id", gaps.alias("gaps"), *_FIGURES, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    # The first piece that a task gathers doesn't know what stands before it.
    joint = (F.col("place").bitwiseAND(F.lit((1 << 32) - 1)) == 0).alias("joint")
    kind = rows.schema["conv_id"].dataType.simpleString()
    rest = parts.select("*", joint).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_joined, f"conv_id {kind}, {_RESULT}")
    out = written(one.unionByName(rest), "repaired")
    remove(rows.sparkSession, at)
    return out


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (rows of a conversation are in order of it), edit (K, R or I), role and text of every row that the repair leaves; see repair()."""
    whole, parts = _pieces(rows, True, workspace(rows.sparkSession, "repair"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pylist()
            lines = [list(zip((e for e in r["edits"] if e != "D"), applied(r["edits"], r["roles"], r["texts"], r["state"]), strict=True)) for r in own]
            at = pa.array([i for i, x in enumerate(lines) for _ in x], pa.int64())
            place = pa.array([[r["place"], n] for r, x in zip(own, lines, strict=True) for n in range(len(x))], pa.list_(pa.int64()))
            flat = [(e, *y) for x in lines for e, y in x]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(at), place, *(pa.array([f[k] for f in flat], pa.string()) for k in range(3))], ["conv_id", "place", "edit", "role", "text"])

    columns = ["conv_id", "place", "roles", "texts", "edits", "state"]
    both = whole.select("*", F.col("audit").alias("edits"), F.lit(0).alias("state")).select(*columns).unionByName(parts.select(*columns))
    return both.mapInArrow(run, f"conv_id {kind}, place array<bigint>, edit string, role string, text string")
