"""Personal data in whole texts: expressions propose spans, checksums confirm them, words nearby adjust a score.

Base kinds, leftmost and without overlap within a kind, found whatever their score:
email; ip (parts at most 255); card (16 to 19 digits, Luhn); phone (+ and 8 to 15 digits).
Further spans are added where the score reaches the threshold: card of 13 to 15 digits (Luhn), phone without + (words nearby needed),
iban (mod 97), ssn (words nearby needed). Added spans never overlap a span of the list so far.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.6
NEAR = 48

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# From the middle of a digit run these fail as they do from its start, so only starts are tried; nothing to go back to, so linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"[A-Z]{2}(?<![A-Za-z0-9]..)[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"[0-9]{3}(?<![0-9A-Za-z+.-]...)\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_SSN = re.compile(r"[0-8][0-9]{2}(?<!000)(?<!666)(?<![0-9A-Za-z-]...)-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

# Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "address", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appel", "llame"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
# The score of a kind before words nearby add to it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4}
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + r")(?![a-z])") for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back from each @ as far as its characters and the match before allow."""
    floor, at = 0, text.find("@")
    while at >= 0:
        low, start = at, at
        while low > floor:  # a run of any length, looked at in pieces
            low = max(floor, start - 256)
            m = _LOCAL_END.search(text, low, start)
            start = m.start() if m else start
            if start > low:
                break
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, (end := m.end())
        floor = end
        at = text.find("@", end)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the longest span that ends at a group's or word's border and that mod 97 confirms: words in capitals, or another IBAN, may follow."""
    at = 0
    while m := _IBAN.search(text, at):
        s, end = m.span()
        at = s + 1
        for e in [end, *(i for i in range(end - 1, s, -1) if text[i] == " ")]:
            if 15 <= len(c := text[s:e].replace(" ", "")) <= 34 and mod97(c):
                yield s, e
                at = e
                break


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": list(_emails(text)) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def score(text: str, kind: str, start: int, end: int, confirmed: bool = True) -> float:
    near = text[max(0, start - NEAR) : start].lower() + " | " + text[end : end + NEAR].lower()
    return round(min(1.0, (PRIOR[kind] if confirmed else 0.4) + 0.3 * bool(_CONTEXT[kind].search(near))), 2)


class _Taken:
    """Spans without overlap, in order, so that whether another one overlaps any takes a search by halves."""

    def __init__(self, own: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(own):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        """Take a span unless it overlaps one."""
        i = bisect.bisect_right(self.ends, s)
        if i < len(self.starts) and self.starts[i] < e:
            return False
        self.starts.insert(i, s)
        self.ends.insert(i, e)
        return True


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """All spans (kind, start, end, score, base) by kind as listed, then start; code points, end exclusive."""
    base = base_spans(text)
    out = {k: [(s, e, score(text, k, s, e), True) for s, e in v] for k, v in base.items()} | {"iban": [], "ssn": []}
    if not _DIGIT.search(text):
        return [(k, *x) for k in KINDS for x in out[k]]
    taken = _Taken([x for v in base.values() for x in v])
    more = [("iban", x, True) for x in _ibans(text)]
    more += [("card", m.span(), True) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15 and d[0] in "3456" and luhn(d)]
    more += [("ssn", m.span(), True) for m in _SSN.finditer(text)]
    more += [("phone", m.span(), False) for m in _LOCAL_PHONE.finditer(text)]
    for kind, (s, e), confirmed in more:
        # Fewer digits agree with Luhn by chance more often; there, words nearby decide.
        x = round(score(text, kind, s, e, confirmed) - 0.3 * (kind == "card"), 2)
        if x >= threshold and taken.add(s, e):
            out[kind].append((s, e, x, False))
    return [(k, *x) for k in KINDS for x in sorted(out[k])]


def _find(threshold: float):
    of_span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])
    names = [f.name for f in of_span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                rows = [[dict(zip(names, x, strict=True)) for x in spans(text or "", threshold)] for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(of_span))], ["doc_id", "spans"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score, base>> of each row; one narrow pass, no shuffle.

    Null and empty texts have no spans; rows with the same id or text are treated one by one; other columns play no part; an
    empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_find(threshold), f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans and strings of all of them, from find()."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.transform("spans", lambda x: x["score"]).alias("scores"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span replaced by its kind in brackets; where spans overlap, the first one stands. Null texts stay null."""

    def run(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for text in batch.column(at).to_pylist():
                out, done = [], 0
                for kind, s, e, *_ in sorted(spans(text or "", threshold), key=lambda x: x[1:3]):
                    if s >= done:
                        out += [text[done:s], f"[{kind}]"]
                        done = e
                texts.append(None if text is None else "".join(out) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
