"""Every query with SQL against DuckDB, over whole tables."""

import os

import duckdb
import pytest

from fieldlore import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "conversations", "supplier", "customer")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    cur = duck.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    key = lambda r: tuple((x is not None, x) for x in r)
    mine = sorted((tuple(r[c] for c in sorted(cols)) for r in got.collect()), key=key)
    at = [cols.index(c) for c in sorted(cols)]
    theirs = sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=key)
    assert len(mine) == len(theirs) > 0 or name in ("fea34_zero_borders", "val21_members")
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 1.1e-6 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL give rows with a schema; their operators are tested by themselves."""
    rows = Q.queries()[name](spark, SF)
    assert rows.columns and len(rows.collect()) >= 0


def test_entry():
    import __spark_entry__ as E

    assert set(Q.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
    assert os.path.exists(SF)
