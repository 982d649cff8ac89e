"""Every named query against its SQL twin in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from specloom.plans import catalog, evaluate

FOLDER = os.environ.get("SPECLOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows and len(set(map(repr, rows))) == len(rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_evaluation_asks_for_every_repeat_and_permutation(spark, monkeypatch):
    asked = {}

    def noted(rows, *args, **kwargs):
        asked.update(kwargs)
        return rows.selectExpr("0D AS value")

    monkeypatch.setattr(evaluate, "evaluate", noted)
    QUERIES["evaluate_representations"](spark, FOLDER)
    assert (asked["repeats"], asked["permutations"]) == (5, 10)
