"""Exact, near, substring and line dedup against brute force."""

import hashlib
import random
import re

import pytest

from wayscope.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from wayscope.llm.components import components


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[fold(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(own), len(own), i == max(own), hashlib.sha256(fold(t).encode()).hexdigest())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())


def test_exact_repeated_rows_null_ids_and_batches(spark):
    d = spark.createDataFrame([(1, "A"), (2, "a"), (2, "a"), (None, "z"), (None, "z"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.dedup(d).collect()))
    assert got == [(0, 0, 2, False), (0, 0, 2, True), (1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup.keep_first(d).count() == 3
    assert exact_dedup.dedup(d.limit(0)).count() == 0


def test_exact_index_lives_in_its_folder(spark, tmp_path):
    d = spark.createDataFrame([(1, "A"), (2, "a"), (2, "a"), (None, "z"), (None, "z"), (3, None), (4, "")], "doc_id long, text string")
    at = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, at, 4)
    exact_dedup.dedup(d, index=index, batches=1).count()
    index.close()
    again = exact_dedup.DigestIndex(spark.newSession(), at)  # another catalog's view of the folder
    assert again.buckets == 4 and again.rows().count() == 3
    batch = spark.createDataFrame([(9, "a"), (10, "new"), (11, "NEW")], "doc_id long, text string")
    later = exact_dedup.dedup(batch, index=exact_dedup.DigestIndex(spark, at), batches=2)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in later.collect()) == [(9, 2, 4, False), (10, 11, 2, False), (11, 11, 2, True)]
    index = exact_dedup.DigestIndex(spark, at)
    assert index.rows().count() == 4 and index.appends == 3
    index.compact()
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    plan = index.lacking(exact_dedup.digests(batch).groupBy("digest").count())._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    known = plan[plan.index("SortMergeJoin") :].split("Scan parquet")[0].split("+- ")[-4:]
    assert not any("Sort [" in x or "Exchange" in x for x in known[-3:])
    exact_dedup.DigestIndex(spark, at).drop()
    assert exact_dedup.DigestIndex(spark, at).table is None


def test_exact_columns_with_any_name(spark):
    d = spark.createDataFrame([(1, "a", 5, 6, b"x"), (2, "A", 7, 8, b"y"), (2, "b", 9, 10, b"z"), (2, "b", 9, 10, b"z")], "doc_id long, text string, gone int, _id int, digest binary")
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns and sorted((r.doc_id, r.text, r.gone, bytes(r.digest)) for r in kept.collect()) == [(2, "A", 7, b"y"), (2, "b", 9, b"z")]
    named = spark.createDataFrame([("x", "a"), ("y", "a")], "doc_id string, text string")
    assert [r.doc_id for r in exact_dedup.keep_first(named).collect()] == ["y"]


@pytest.mark.parametrize("fails", [0, 1, 2, 3])
def test_index_after_a_failed_append(spark, tmp_path, monkeypatch, fails):
    """A call that dies between its writes, at any batch, leaves the index as it was; done anew, here or in a later session, counts are right."""
    at = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    more = spark.createDataFrame([(4, "a"), (5, "c"), (6, "C"), (7, "b"), (8, "c"), (9, "d")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, at, 4)
    if fails < 3:
        exact_dedup.dedup(first, index=index).count()
    real, calls = exact_dedup.DigestIndex._write, []

    def dies(self, rows, mode):
        calls.append(1)
        if len(calls) == min(fails, 2) + 1:
            raise OSError("lost")
        real(self, rows, mode)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_write", dies)
    with pytest.raises(OSError, match="lost"):
        exact_dedup.dedup(more if fails < 3 else first, index=index)
    monkeypatch.setattr(exact_dedup.DigestIndex, "_write", real)
    if fails == 1:  # a later session
        index.close()
        index = exact_dedup.DigestIndex(spark, at)
    if fails == 3:
        exact_dedup.dedup(first, index=index).count()
    got = {r.doc_id: (r.group_size, r.kept) for r in exact_dedup.dedup(more, index=index).collect()}
    assert got == {4: (3, False), 5: (3, False), 6: (3, False), 7: (2, False), 8: (3, True), 9: (1, True)}
    index.compact()
    index.close()
    again = exact_dedup.DigestIndex(spark, at)
    assert again.rows().count() == 4 and {r.group_size for r in again.counts().collect()} == {1, 2, 3}
    again.drop()


def test_text_ids_are_refused(spark):
    d = spark.createDataFrame([("x", "one two three"), ("y", "one two three")], "doc_id string, text string")
    for f in (substring_dedup.dedup, near_dedup.classes, near_dedup.keep_one):
        with pytest.raises(TypeError, match="whole numbers"):
            f(d)


def brute_repeats(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(words) - n + 1):
            key = tuple(words[s : s + n])
            gone.update(range(s, s + n)) if key in seen else seen.add(key)
        out[i] = (len(words), len(gone), " ".join(x for j, x in enumerate(words) if j not in gone))
    return out


def check_repeats(docs, rows, n=20):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(docs, window=n).collect()}
    assert got == brute_repeats(rows, n)


def test_substrings(docs, rows):
    check_repeats(docs, rows)
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.dedup(docs, with_text=False).collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, _, t) in brute_repeats(rows, 20).items()}


def test_substrings_of_few_letters(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 19, 20, 21, 60, 200])))) for i in range(50)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows, 9)


def test_substrings_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(empty).count() == 0
    words = " ".join(str(i) for i in range(30))
    d = spark.createDataFrame([(None, words), (1, words), (1, words)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(d).collect()) == [(0, 0), (1, 30), (1, 30)]


def brute_classes(rows, similarity=0.8):
    sets = {}
    for i, t in rows:
        x = fold(t).encode().split()
        if x:
            sets[i] = {tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_keeps_columns_with_any_name(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, "x", 5, 6)], "doc_id long, text string, gone int, _other int")
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", 1, 2), (3, "x", 5, 6)]


def test_near(docs, rows):
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == brute_classes(rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(brute_classes(rows).values())


def test_near_chains_and_families(spark):
    rng = random.Random(8)
    rows, base = [], [str(rng.randrange(10**6)) for _ in range(200)]
    for i in range(40):  # each is close to the one before, the first and last are far apart
        base = list(base)
        base[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(str(rng.randrange(50)) for _ in range(60))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()} == brute_classes(rows)


def test_near_pairs_among_near_misses(spark):
    # Documents are lines of a plane over 13: each changes five words of a text, any two change one common place at most (similarity 0.77 or
    # 0.79). The two of a pair write the same word where they meet (0.81).
    q = 13
    at = {(a, b): [c * q + (a * c + b) % q for c in range(5)] for a in range(q) for b in range(q)}
    own = {x: {p: f"{x[0]}_{x[1]}_{p}" for p in places} for x, places in at.items()}
    for b in range(q):
        for a in range(0, 8, 2):  # lines (a, b) and (a + 1, b) meet in column 0
            own[a + 1, b][at[a, b][0]] = own[a, b][at[a, b][0]]
    rows = [(i, " ".join(own[x].get(j // 5, f"w{j}") if j % 5 == 2 else f"w{j}" for j in range(384))) for i, x in enumerate(own)]
    want = brute_classes(rows)
    assert len(set(want.values())) == q * q - 4 * q
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()}
    assert got == want, sum(got[i] != want[i] for i in want)


def families(seed=4, bases=3, others=60, words=400):
    """Texts like check tables' large groups: edits of a base, from a few to so many that links are rare, and pairs just at the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(others):
            own = list(base)
            for place in rng.sample(range(words), rng.randint(1, 30)):
                own[place] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_in_small_blocks(spark):
    rows = families()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_classes(rows)
    for options in ({}, {"block": 4, "star": 4}, {"block_shingles": 1500, "star": 1}):
        got = {r.doc_id: r.class_id for r in near_dedup.classes(d, **options).collect()}
        assert sum(got[i] != want[i] for i in want) == 0, options


def test_near_pair_among_hundreds_just_below(spark):
    # X and D are linked (333 of 416 shingles); each of the others is X with as many words changed elsewhere, one more of them far apart.
    rng = random.Random(2)
    rows = []
    for f in range(2):
        base = [f"f{f}w{i}" for i in range(379)]

        def edited(places, base=base):
            own = list(base)
            for p in places:
                own[p] = f"n{rng.randrange(10**9)}"
            return " ".join(own)

        rows.append((len(rows), " ".join(base)))
        rows.append((len(rows), edited([10 + 40 * i for i in range(8)] + [11])))
        for _ in range(150):
            rows.append((len(rows), edited(rng.sample(range(5, 370, 9), 9))))
    want = brute_classes(rows)
    assert want[1] == 0
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()}
    assert got == want, sum(got[i] != want[i] for i in want)


def test_near_bands_follow_the_similarity():
    assert near_dedup.bands(0.8) == (25, 5) and near_dedup.bands(0.5) == (62, 2) and 0.6 < near_dedup.likely(0.8) < 0.65
    for s in (0.3, 0.5, 0.7, 0.9, 1.0):
        count, rows = near_dedup.bands(s)
        assert (1 - s**rows) ** count <= near_dedup.MISS and count * rows <= near_dedup.K


def test_near_weighted_and_edges(spark):
    rows = [(1, "a " * 50), (2, "a " * 52), (3, "a " * 500), (None, "a " * 50), (5, None), (6, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(d, weighted=True).collect()}
    assert got == {None: None, 1: None, 2: None, 3: 3, 5: 5, 6: 6}
    assert len({r.class_id for r in near_dedup.classes(d).where("doc_id < 4").collect()}) == 1
    assert near_dedup.classes(d.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    code = rng.integers(1, 2**62, 300).astype(np.uint64)
    sign = near_dedup.signatures(np.repeat([0, 1], 300), np.concatenate((code, code)), np.concatenate((a, b)), 2, 2000)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in rng.sample(range(100, 140), 40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_lines(spark, docs, rows):
    table = [(i, f"s{i % 12}", "common line\n unique %d \n\ncommon line\t\nrare %d" % (i, i % 2)) for i in range(40)] + [(90, None, None), (91, "s1", "rare 0\n"), (92, "", "common line")]
    d = spark.createDataFrame(table, "doc_id long, source string, text string").repartition(3)
    for least in (2, 6, 8, 12, 14):
        sites = {}
        for _, s, t in table:
            for x in (t or "").split("\n"):
                if k := x.strip(" \t\r"):
                    sites.setdefault(k, set()).add(s or "")
        want = {}
        for i, _, t in table:
            own = (t or "").split("\n")
            kept = [x for x in own if len(sites.get(x.strip(" \t\r"), ())) < least]
            want[i] = (len(own), len(own) - len(kept), "\n".join(kept))
        assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup(d, least).collect()} == want
    assert line_dedup.dedup(d.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a", "x\ny"), (1, "b", "z\nx")], "doc_id long, source string, text string")
    assert sorted(r.kept_text for r in line_dedup.dedup(twice, 2).collect()) == ["y", "z"]
