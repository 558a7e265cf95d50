import pytest

#: A document of every awkward kind; w() makes words.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def w(n, start=0, step=1):
    return " ".join(WORDS[(start + i * step) % len(WORDS)] + str((start + i * step) // len(WORDS) % 7) for i in range(n))


@pytest.fixture(scope="session")
def rows():
    shared = w(60, 5, 5)
    out = [(1, w(40)), (2, "pre " + shared + " post one"), (3, w(30, 100, 3) + " " + shared), (4, w(40)), (5, w(40).upper()), (6, None), (7, ""), (8, "  \n\t "), (9, "one"), (10, "one two three four")]
    out += [(11, "one"), (12, "x " * 400), (13, "x " * 410), (14, w(3000, 7, 11)), (15, shared + " " + shared), (16, "line a\nline b\n\nline c"), (17, "  line a \nother\r\nline b"), (18, "ünï çödé 漢字 " * 9)]
    out += [(20 + i, w(120, 9, 7).replace("beta", f"edit{i}", i % 3)) for i in range(6)] + [(40, w(40)), (41, w(19)), (42, w(20))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    table = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else None, len(t or ""), "kept") for i, t in rows]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, digest string").repartition(3).cache()
