"""Every query against its SQL over the smallest tables."""

import math

import duckdb
import pytest

from millrace.plans.queries import QUERIES, SQL

HOME = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{HOME}/{name}.parquet'")
    return con


def plain(row):
    return tuple("~" if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    made = QUERIES[name](spark, HOME)
    columns = sorted(made.columns)
    found = db.sql(SQL[name])
    assert columns == sorted(found.columns)
    expected = found.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, map(plain, made.select(*columns).collect()))) == sorted(map(str, map(plain, expected)))
