"""Every registered query of the engine against its oracle SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from spindrift import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, float) and x != x or x is None or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return bool(x)
        if hasattr(x, "item"):
            x = x.item()
        return round(float(x), 4) + 0.0 if isinstance(x, (int, float)) else str(x)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().shape[1]


def test_chunks_change_nothing(spark):
    a, b = (QUERIES[n](spark, SF).toPandas() for n in ("lif_run", "lif_chunked"))
    assert rows(a) == rows(b) and len(a) > 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
