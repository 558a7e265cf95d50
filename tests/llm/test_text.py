"""Personal data, toxicity, tokens and packing."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayscope.llm import packing, pii, token_counts, toxicity
from wayscope.llm.queries import tokenizer

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)], "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1@.-_+%0 ()é4,", max_size=60) | st.lists(st.sampled_from(["a@b.c", "4111 1111 1111 1111", "1.2.3.4", "+49 30 1234567", "256.1.1.1", ".", " ", "@", "é"]), max_size=8).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_added_spans_need_checksums_and_context():
    found = lambda t: [x[0] for x in pii.spans(t)]
    assert found("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"] and found("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert found("call 212-555-0100 today") == ["phone"] and found("part 212-555-0100 today") == []
    assert found("ssn 123-45-6789") == ["ssn"] and found("no 123-45-6789") == []
    assert found("amex card 378282246310005") == ["card"] and found("id 378282246310005") == []
    assert pii.spans("a" * 200_000 + "1" * 50_000 + "@" * 1000) == []


@pytest.mark.parametrize("after", ["BIC COBADEFFXXX", "2024", "GB82 WEST 1234 5698 7654 32", "now", ""])
def test_iban_before_capitals_and_digits(after):
    iban = "DE89 3704 0044 0532 0130 00"
    text = f"REF NO12 3456 {iban} {after}"
    found = [text[s:e] for k, s, e, *_ in pii.spans(text) if k == "iban"]
    assert found == [iban, *([after] if after.startswith("GB82") else [])]
    assert [x for x in pii.spans(text.replace("DE89", "DE87").replace("GB82", "GB81")) if x[0] == "iban"] == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=12))
def test_added_spans_never_overlap(base, more):
    base, taken = [(s, s + n) for s, n in base], []
    own = pii._Taken(base)
    for s, n in more:
        free = not any(s < b and a < s + n for a, b in base + taken)
        assert own.add(s, s + n) == free
        taken += [(s, s + n)] if free else []


def test_many_spans_in_one_text():
    """Time grows with the text: a list of contacts four times as long takes about four times as long."""
    import time

    line = "mail a{0}@b.co, call 212-555-{0:04d}, card 4111 1111 1111 1111, ip 10.0.{1}.1, account DE89 3704 0044 0532 0130 00, ssn 123-45-{0:04d}; "
    took = []
    for n in (1000, 4000):
        text = "".join(line.format(i % 9999 + 1, i % 256) for i in range(n))
        began = time.process_time()
        assert len(pii.spans(text)) >= 5 * n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_pii_table(spark, docs):
    d = spark.createDataFrame([(1, "x é a@b.co, 10.0.0.1"), (2, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(d)).collect()}
    assert got[1].spans == "email:4:10,ip:12:20" and (got[1].n_email, got[1].n_ip, got[2].n_card) == (1, 1, 0) and got[2].spans == ""
    assert {r.text for r in pii.redact(d).collect()} == {"x é [email], [ip]", None, ""}
    assert pii.redact(docs).columns == docs.columns and pii.find(d.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=80))
def test_windows_hold_everything_once(sizes):
    out = packing.windows(sizes)
    assert sorted(i for own in out for i in own) == list(range(len(sizes))) and all(sum(sizes[i] for i in own) <= packing.CAPACITY for own in out)


def test_differencing_is_nearly_even():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1024) for _ in range(3000)]
    sums = [sum(sizes[i] for i in own) for own in packing.differencing(sizes, 400)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 200  # of 3800 each
    two = [sum([8, 7, 6, 5, 4][i] for i in own) for own in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(two) == [14, 16]  # the known result of differencing on these numbers


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows}


def test_packing(docs, rows, ids):
    got = packing.pack(docs, tokenizer(), group=7).toPandas()
    for i, own in got.sort_values("start").groupby("doc_id"):
        whole = np.array(ids[i] + [2], "<u4")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(whole) and set(own.doc_tokens) == {len(whole)}
        assert all(zlib.crc32(whole[s : s + n]) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    assert set(got.doc_id) == {i for i, _ in rows}
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 4096
    assert packing.pack(docs.limit(0), tokenizer()).count() == 0


def test_odd_words_have_the_tokenizers_ids(spark):
    texts = ["Don't STOP.. it's ok", "a.<|ENDOFTEXT|>, <|endoftext|>.", "ΣΑΣ. İstanbul ʰa ªb ½ Ⅷ", "é ǻ x\x1cy\x0bz w", "東京, 한국. ไทย", ".", ",", "12. 3, .,"]
    import pyarrow as pa
    from tokenizers import Tokenizer

    from wayscope.llm.tokens import WordEncoder

    plain_ids = [x.ids for x in Tokenizer.from_file(tokenizer()).encode_batch(texts, add_special_tokens=False)]
    for most in (400_000, 3):
        e = WordEncoder(tokenizer(), most)
        for _ in range(2):
            got, at = e.ids(pa.array([*texts, None]))
            assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [*plain_ids, []]


def test_token_counts(spark, docs, ids):
    n = np.array([len(x) for x in ids.values()])
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs, tokenizer()))).cache()
    for r in sums.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.tokens_truncated) == ((n == r.length).sum(), (n >= r.length).sum(), n[n >= r.length].sum(), np.minimum(n, r.length).sum())
        assert abs(r.share_at_most - (n <= r.length).mean()) < 1e-12
    limits = [0, 1, 50, 10**6]
    assert {r.limit: (r.n_docs_cut, r.tokens) for r in token_counts.truncated_totals(sums, limits).collect()} == {x: ((n > x).sum(), np.minimum(n, x).sum()) for x in limits}
    assert {r.share: r.length for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: np.sort(n)[-(-len(n) // 2) - 1], 1.0: n.max()}
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs.limit(0), tokenizer()))).count() == 0


def labelled(spark, n=900):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        words = [rng.choice(common) for _ in range(rng.randint(20, 80))]
        for _ in range(toxic * rng.randint(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(["Grumblefoot", "snarlpit,", "vilemaw"]))
        rows.append((i, " ".join(words)))
        labels.append((i, None, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_held_out(spark):
    d, labels = labelled(spark)
    extra = d.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (None, "vilemaw snarlpit, Grumblefoot vilemaw")], d.schema))
    got = {r.doc_id: r for r in toxicity.score(extra, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(900))
    own = [got[i] for i in range(900) if got[i].held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in own) / len(own) > 0.97
    assert got[-1].predicted == got[-2].predicted == 0 and got[None].predicted == 1 and got[None].evidence[0].toxic == 1
    kept = toxicity.keep_clean(extra, labels)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_copies_of_one_toxic_text_hide_no_other(spark):
    d, labels = labelled(spark)
    words = random.Random(6)
    long = " ".join("".join(words.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(400))  # thousands of grams of its own
    copies = [(1000 + i, long.upper() if i % 2 else long) for i in range(600)]
    d = d.unionAll(spark.createDataFrame(copies, d.schema))
    labels = labels.unionAll(spark.createDataFrame([(i, None, 1) for i, _ in copies], labels.schema))
    got = {r.doc_id: r for r in toxicity.score(d, labels).collect()}
    own = [r for i, r in got.items() if i < 900 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in own) / len(own) > 0.97
    assert all(got[i].predicted for i, _ in copies)


def test_toxicity_without_examples(spark):
    d, labels = labelled(spark, 12)
    assert {r.predicted for r in toxicity.score(d, labels.limit(0)).collect()} == {0}
    assert toxicity.score(d.limit(0), labels).count() == 0


def brute_toxicity(docs, labels):
    """Scores from texts by the rules that the module states, with dictionaries."""
    fold = {i: " " + re.sub(rb"[^a-z0-9\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())).decode("latin1") + " " for i, t in docs}
    grams = {i: Counter(x[j : j + 6] for j in range(len(x) - 5)) for i, x in fold.items()}
    known = {i: y for i, y in labels if i in fold and zlib.crc32(str(i).encode()) % 4 != 2}
    of = {}
    for i in sorted(known):
        of.setdefault(fold[i], []).append(i)
    example = {v[0]: max(known[i] for i in v) for v in of.values()}
    k, m = sum(example.values()), sum(1 - y for y in example.values())
    a, b = (Counter(g for i, y in example.items() if y == side for g in grams[i]) for side in (1, 0))
    tried = [g for g in a | b if a[g] + b[g] >= 4]

    def apart(g):
        s = (a[g] + b[g]) / (k + m)
        cells = (a[g], k * s), (b[g], m * s), (k - a[g], k * (1 - s)), (m - b[g], m * (1 - s))
        return 2 * sum(x * math.log(x / e) for x, e in cells if x > 0)

    terms = {g for g in tried if a[g] / k > b[g] / m and apart(g) >= 1.5 * math.log(max(2, len(tried)))}
    df = Counter(g for x in grams.values() for g in x if g in terms)
    vectors = {}
    for i, x in grams.items():
        v = {g: (1 + math.log(n)) * (math.log((len(docs) + 1) / (df[g] + 1)) + 1) for g, n in x.items() if g in terms}
        size = math.sqrt(sum(w * w for w in v.values()))
        vectors[i] = {g: w / size for g, w in v.items()}
    prior = (k + 0.1) / (k + m + 1)

    def vote(i, own=None):
        near = sorted(((-sum(w * vectors[e].get(g, 0) for g, w in vectors[i].items()), e) for e in example if e != own and vectors[e]))[:25]
        near = [(-c, e) for c, e in near if c < 0]
        return (sum(c * example[e] for c, e in near) + 0.5 * prior) / (sum(c for c, _ in near) + 0.5)

    votes = sorted((vote(e, e), y) for e, y in example.items() if vectors[e])
    blank = [y for e, y in example.items() if not vectors[e]]
    x, y = toxicity.isotonic(np.array([v for v, _ in votes]), np.array([float(l) for _, l in votes]))
    score = lambda v: 0.95 * np.interp(v, x, y) + 0.05 * v
    alone = {fold[e] for e, y in example.items() if y and not vectors[e]}
    return {i: score(vote(i)) if vectors[i] else score((1 + 0.5 * prior) / 1.5) if fold[i] in alone else (sum(blank) + prior) / (len(blank) + 1) for i in fold}


def test_toxicity_is_what_brute_force_gives(spark):
    rng = random.Random(12)
    bad, plain = ["vilefoo", "grimbar", "nastyqux"], [f"word{i}" for i in range(40)]
    rows = []
    for i in range(330):
        own = [rng.choice(plain) for _ in range(rng.randint(0, 30))] + [rng.choice(bad) + rng.choice(["", "s", "ing"]) for _ in range(2 * (i % 5 == 0))]
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    labels = [(i, int(i % 5 == 0) if rng.random() < 0.95 else int(i % 5 != 0)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    want = brute_toxicity(rows, labels)
    # Examples with equal cosines at the 25th place may differ in which one votes.
    close = [abs(got[i].score - want[i]) < 1e-6 for i in want]
    assert sum(close) / len(close) > 0.9 and max(abs(got[i].score - want[i]) for i in want) < 0.2
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in want)


def test_block_bounds_change_no_neighbour():
    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(500), 6)
    term = np.concatenate([np.sort(rng.choice(80, 6, replace=False)) for _ in range(500)])
    count = rng.integers(1, 5, len(row))
    index = toxicity.Index(rng.random(80) + 1, np.arange(500), rng.integers(0, 2, 500), row, term, count)
    for _ in range(50):
        t = np.sort(rng.choice(80, 5, replace=False))
        q = rng.random(5)
        at, cos = index.nearest(t, q, 10)
        dense = np.zeros((80, 500))
        dense[np.repeat(np.arange(80), np.add.reduceat(index.run_size, index.of_term[:-1])), index.at] = index.weight
        every = q @ dense[t]
        best = np.lexsort((np.arange(500), -every))[:10]
        assert np.allclose(cos, every[best][: len(cos)]) and set(at[cos > cos.min() + 1e-9]) <= set(best)
