"""Every query with SQL against DuckDB on the smallest data; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        out.append(tuple("" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("p") and n not in entry_module.core.queries()) + [n for n in sorted(SQL) if n.startswith("p") and not n[1:2].isdigit() or n in entry_module.core.queries()])
def test_query_equals_sql(spark, duck, name):
    got, want = entry_module.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in sorted(entry_module.queries()) if n not in SQL and not (n[0] == "p" and n[1:2].isdigit() and n not in entry_module.core.queries())])
def test_query_runs(spark, name):
    assert entry_module.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20
