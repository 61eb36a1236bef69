"""Every registered core query runs, and equals its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pagewright.plans.oracles import oracle_sql
from pagewright.plans.queries import queries

Q, O = queries(), oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(O))
def test_equals_sql(spark, sf, duck, name):
    df = Q[name](spark, sf)
    r = duck.execute(O[name])
    assert table(df.columns, df.collect()) == table([x[0] for x in r.description], r.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
