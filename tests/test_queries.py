"""Every query with a statement against DuckDB on the smallest tables; the rest must run."""

from __future__ import annotations

import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import connect, same_rows
from tidemark.queries import engine, engine_sql, interchange, market, market_sql, preparation, preparation_sql

QUERIES = engine.QUERIES | market.QUERIES | preparation.QUERIES | interchange.QUERIES
SQL = engine_sql.SQL | market_sql.SQL | preparation_sql.SQL | interchange.SQL


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    ours = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        same_rows(ours, duck.execute(SQL[name]).fetchdf())


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "event_id"


@pytest.mark.skipif(importlib.util.find_spec("tidemark.llm") is None, reason="needs the subpackage")
def test_a_missing_package_is_an_error():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__; __spark_entry__.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=60)
    assert done.returncode and ("ImportError" in done.stderr or "ModuleNotFoundError" in done.stderr)


def test_an_absent_subpackage_is_none(monkeypatch):
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(QUERIES)
