"""The augmentation queries over documents of any length, empty and very short ones too, against their SQL."""

import os
import shutil

import duckdb
import pytest
from test_queries import HOME, TABLES, plain

from millrace.plans import tables
from millrace.plans.queries import QUERIES, SQL

NAMES = sorted(name for name in SQL if name.split("_")[0] in "a2 a3 a4 a5 a7 a8 a10 a12 a13 a14".split())


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """The smallest tables with 40 documents, and an empty, a one-word and a two-word text."""
    out = str(tmp_path_factory.mktemp("whole"))
    for name in TABLES:
        if name != "documents":
            (shutil.copytree if os.path.isdir(f"{HOME}/{name}.parquet") else shutil.copy)(f"{HOME}/{name}.parquet", f"{out}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE d AS FROM '{HOME}/documents.parquet' ORDER BY doc_id LIMIT 40")
    for i, text in enumerate(("", "good", "good staff")):
        con.execute(f"INSERT INTO d SELECT * REPLACE (900002 + {i} AS doc_id, ? AS text) FROM d LIMIT 1", [text])
    con.execute(f"COPY d TO '{out}/documents.parquet'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_no_limit_of_words(spark, home, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM '{home}/{table}.parquet'")
    made = QUERIES[name](spark, home)
    found = con.sql(SQL[name])
    columns = sorted(made.columns)
    expected = found.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, map(plain, made.select(*columns).collect()))) == sorted(map(str, map(plain, expected)))


def test_originals_are_all_samples(spark, home):
    assert tables.originals(spark, home).count() == 43 and tables.variants(spark, home).where("variant_index = 0").count() == 43
