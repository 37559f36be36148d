"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest
from conftest import DATA

from pictorium import plans

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(cols, values):
    return sorted(tuple(str(v[c]) for c in cols) for v in values)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    r = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    assert rows(cols, [x.asDict() for x in df.collect()]) == rows(cols, [dict(zip(names, x, strict=True)) for x in r.fetchall()])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() >= 0
