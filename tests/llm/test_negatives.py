"""Hard negatives against SQL over the smallest table and a brute-force search of made rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import entries, negatives

HOME = "/root/testdata/sf0.001"


def brute(rows, is_anchor, positives=5, k=5):
    """rows: {id: (label, integer vector)}."""
    out = []
    for a in filter(is_anchor, rows):
        score = {r: int(np.dot(rows[a][1], rows[r][1])) for r in rows if r != a}
        order = sorted(score, key=lambda r: (-score[r], r))
        for p in [r for r in order if rows[r][0] == rows[a][0]][:positives]:
            window = [r for r in order if rows[r][0] != rows[a][0] and 80 * score[p] <= 100 * score[r] <= 100 * score[p]]
            out += [(a, p, i + 1, n, score[p], score[n]) for i, n in enumerate(window[:k])]
    return sorted(out)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{HOME}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = con.sql(entries.OP12_SQL).select(*names).fetchall()
    found = entries.op12_hard_negatives(spark, HOME)
    assert found.columns == names and [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert len(expected) > 20 and sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("seed", range(3))
def test_made_rows(spark, seed):
    """Few directions, so that scores tie, windows overlap and vectors repeat; a third of the rows is one vector; some scores are negative."""
    r = np.random.default_rng(seed)
    n = 300
    vectors = r.integers(-4, 8, (40, 6))[r.integers(0, 40, n)]
    vectors[: n // 3] = vectors[0]
    labels = r.integers(0, 3 if seed else 40, n)
    labels[::2] = 1
    rows = [(int(i), int(l), [x / 4 for x in v.tolist()]) for i, (l, v) in enumerate(zip(labels, vectors))]
    expected = brute({i: (l, np.floor(np.array(v) * 4).astype(int)) for i, l, v in rows}, lambda i: i % 10 == 0)
    extra = [(None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1010, 1, None), (1020, 1, [None] * 6), (1030, 1, [float("nan")] * 6), (1040, 1, [1.0] * 5), (1050, 1, []), *rows[:20]]
    df = spark.createDataFrame(rows + extra, "vec_id long, label int, embedding array<double>").withColumn("slot", F.lit(1)).withColumn("LIMITS", F.lit(2))
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, scale=4.0, shard_rows=70, block_rows=11)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 50


def test_no_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df.where("vec_id > 0"), F.col("vec_id") % 10 == 0).count() == 0
