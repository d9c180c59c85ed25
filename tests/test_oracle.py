"""Every query with SQL gives the same rows as DuckDB at the smallest scale; the rest give rows."""

import duckdb
import numpy as np
import pytest

from texloom.plans.all import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_are_finite(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        if "data" in r.asDict():
            assert np.isfinite(r["data"]).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
