"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from evokeline.plans.library import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    def one(v):
        return "null" if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(r[n]) for n in names) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    r = con.sql(SQL[name])
    assert sorted(r.columns) == names
    theirs = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
    ours, theirs = plain([r.asDict() for r in df.collect()], names), plain(theirs, names)
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if any((abs(x - y) > 2e-6 if isinstance(x, float) and isinstance(y, float) else x != y) for x, y in zip(a, b, strict=True))]
    assert not wrong[:3]


def test_every_query_is_named():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
