"""Every query with SQL must give the same rows as DuckDB on the given tables."""

import datetime
import math
import os

import duckdb
import pytest

from fieldlake.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def order(row):
    return tuple((v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=order)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert isinstance(frame.first()["anchor_date"], datetime.date)
