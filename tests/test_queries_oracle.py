"""All core queries against their SQL over a small copy of the driver's tables (skipped where they aren't there)."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from colloquy.plans import conversation_queries, inline_queries, network_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = {name: query for module in (conversation_queries, network_queries, inline_queries) for name, query in module.QUERIES.items()}
SQL = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or ("float" in type(v).__name__ and v != v):
        return None
    if "bool" in type(v).__name__:
        return bool(v)
    # a column of longs with nulls may come as floats
    return round(float(v), 5) + 0.0 if "float" in type(v).__name__ or "int" in type(v).__name__ else str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(CORE) & set(SQL)))
def test_query_equals_sql(spark, duck, name):
    assert rows(CORE[name](spark, str(DATA)).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_louvain_runs(spark):
    assert CORE["louvain"](spark, str(DATA)).count() > 0
