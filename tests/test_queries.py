"""Every query with SQL gives the same rows as its SQL; the others run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from docquarry.plans import reference_queries

NAMES = sorted(reference_queries.QUERIES)


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is pd.NA:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in zip(*[frame[c] for c in cols])), key=repr)


@pytest.fixture(scope="module")
def con(data):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    got = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    assert sql is not None, "every query of the core has SQL"
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert len(entry.entry(spark).schema) == 4
