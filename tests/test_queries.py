"""Every registered query of the engine against DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from marlstone.plans import catalogue
from marlstone.plans.registry import TABLES


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    if name in catalogue.ORACLES:
        oracle.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in oracle.description]
        assert sorted(columns) == names
        assert got == sorted(repr(tuple(plain(dict(zip(columns, r))[c]) for c in names)) for r in oracle.fetchall())


def test_entry_imports_without_the_optional_parts():
    """With the optional subpackage and the pipeline hidden, the entry module still imports."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['marlstone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalogue.QUERIES) and out[1:] == ["False", "False"]
