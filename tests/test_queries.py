"""Each query with SQL gives what another engine gives for it; the rest run."""

from __future__ import annotations

import os

import duckdb
import pytest

from draftlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def shown(v):
    if v is None:
        return "null"
    if isinstance(v, bool | str | int):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    try:
        return f"{float(v) + 0.0:.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert columns
        return
    other = duck.sql(SQL[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[k]) for k in at) for r in other.fetchall())


def test_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_package():
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['draftlens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm_registry is None and 'transitions' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(SQL) - {"composed_hashes", "provenance_hash"}))  # composition is Python's, there is none in this SQL
def test_no_python_where_sql_can_say_it(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_scans_are_pruned(spark):
    text = plan(QUERIES["pricing_summary"](spark, SF))
    assert "LessThanOrEqual(l_shipdate" in text and "l_orderkey" not in text
    text = plan(QUERIES["label_counts"](spark, SF))
    assert "ReadSchema: struct<event_type:string>" in text
    text = plan(QUERIES["daily_activity_dense"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text and "user_id" not in text


def test_large_projects_are_cut_by_time(spark):
    """No window over project alone stands above the rows of the log."""
    text = plan(QUERIES["sessions_gap"](spark, SF))
    assert "hashpartitioning(project" in text and "_bucket" in text
