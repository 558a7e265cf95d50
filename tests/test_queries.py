"""Every audit query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from wayscope import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(rows):
    return sorted([tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, str(DATA))
    ours = plain(df.select(*sorted(df.columns)).collect())
    assert ours
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    theirs = plain([tuple(r[i] for i in order) for r in want.fetchall()])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_curves_hold_the_kde(spark):
    """The whole result of the density chart is made of the curves that SQL holds."""
    got = {r.track_id: r for r in queries.QUERIES["density_curves"](spark, str(DATA)).collect()}
    want = {}
    for r in queries.QUERIES["kde_curve"](spark, str(DATA)).collect():
        want.setdefault(r.track_id, {})[r.grid_i] = round(r.y, 6)
    assert {t: {p.grid_i: round(p.y, 6) for p in r.time_curve} for t, r in got.items() if r.time_curve} == want
    assert all(r.time_peaks == len(r.time_tops) and r.distance_peaks == len(r.distance_tops) for r in got.values())


def test_without_the_llm_folders(tmp_path):
    """A copy of the repository without them imports, and lists the audit's queries."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; from wayscope import queries; assert e.queries().keys() == queries.QUERIES.keys() and e.oracle_sql() == queries.ORACLE; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == str(len(queries.QUERIES)), out.stderr
