"""Every registered core query with SQL equals that SQL, on the small tables."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldweave.plans.oracle import ORACLE_SQL
from fieldweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        return float(v)
    return str(v) if not isinstance(v, (pd.Timestamp, datetime.datetime)) else v.isoformat()


def rows(df):
    df = df[sorted(df.columns)]
    found = [tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: repr((tuple(v for v in r if not isinstance(v, float)), tuple(round(v, 3) for v in r if isinstance(v, float)))))


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    assert not [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
