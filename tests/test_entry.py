"""The driver's contract, and the core without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL, MEDIUM = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")


def test_contract():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 60 and all(callable(f) for f in q.values())


def test_core_stands_alone():
    """Nothing outside the subpackage imports it, and the entry works without it."""
    code = "import sys\nclass No:\n def find_spec(self, name, *a):\n  if name.startswith('lumiscript.llm'): raise ImportError(name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e, lumiscript.plans.jobs, lumiscript.sources.files, lumiscript.streaming.signals\nassert not any(k.startswith('p1') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    core = [p for p in (ROOT / "lumiscript").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert core and not [p for p in core if "lumiscript.llm" in p.read_text(encoding="utf-8")]


@pytest.mark.skipif(not SMALL.exists(), reason="the test tables aren't here")
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns[0] == "doc_id"


def core_names():
    from lumiscript.more_oracle import MORE_SQL
    from lumiscript.oracle import SQL

    return sorted({**SQL, **MORE_SQL})


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for p in MEDIUM.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not MEDIUM.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", core_names())
def test_oracle(spark, duck, name):
    """Every query with SQL gives the same rows, and has some."""
    import __spark_entry__ as e

    r = duck.execute(e.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    want = r.fetchall()
    got = [tuple(x[c] for c in cols) for x in e.queries()[name](spark, str(MEDIUM)).collect()]
    tidy = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in x) for x in rows], key=repr)
    assert want and tidy(got) == tidy(want)
