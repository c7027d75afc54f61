"""Vector codes against SQL over the smallest table and against plain assignment of made vectors."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import codes, entries

HOME = "/root/testdata/sf0.001"


def lloyd(x, first, rounds):
    """x, first: (n or k, parts, width) whole numbers."""
    book = first.transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if r < rounds:
            for p in range(book.shape[0]):
                for e in range(book.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        book[p, e] = own.sum(axis=0) // len(own)
    return book, code, d.min(axis=2).sum(axis=1)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{HOME}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    expected = con.sql(entries.op11_sql()).select(*names).fetchall()
    found = entries.op11_vector_codes(spark, HOME)
    assert found.columns == names and len(expected) > 100
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("seed", range(4))
def test_balls_are_plain_assignment(seed):
    """The rounds by themselves: clusters, ties and equal entries; some balls must be left alone, and fewer distances computed."""
    r = np.random.default_rng(seed)
    k, n = 8, 3000
    spread_ = (0.3, 2.0, 6.0, 0.0)[seed]
    x = np.floor(r.integers(-40, 40, (k, 1, 3))[r.integers(0, k, n)] + r.normal(0, spread_, (n, 1, 3))).astype(np.int64)
    first = x[:k].copy()
    book, code, _ = lloyd(x, first, 6)
    now_book, own, radius, moved = first.transpose(1, 0, 2).copy(), None, np.full((1, k), np.inf), np.ones((1, k), bool)
    work = 0
    for t in range(7):
        now = codes.neighbours(now_book, radius, moved)
        if own is None:
            own = codes.plain(x[:, 0], now_book[0])
            far = np.full((1, k), -1, np.int64)
            np.maximum.at(far[0], own, codes.squared(x[:, 0], now_book[0][own]))
        else:
            own, reach, done = codes.reassigned(x[:, 0], own, now, 0)
            far, work = reach[None], work + done
        if t < 6:
            count = np.bincount(own, minlength=k)[None]
            total = np.zeros((1, k, 3), np.int64)
            np.add.at(total[0], own, x[:, 0])
            now_book, radius, moved = codes.moved_on(now, count, total, radius, far)
            inside = np.sqrt(codes.squared(x[:, 0], now_book[0][own]))
            assert (inside <= radius[0][own] * (1 + 1e-9)).all()
    assert (now_book == book).all() and (own == code[:, 0]).all()
    assert work < 6 * n * k / 2


@pytest.mark.parametrize("dim,rows", [(16, 500), (10, 60), (8, 5)])
def test_made_rows(spark, dim, rows, monkeypatch):
    """Copies, null and repeated ids, several packs and buckets, vectors that don't divide, fewer rows than entries."""
    monkeypatch.setattr(codes, "PACK", 40)
    r = np.random.default_rng(dim)
    v = r.integers(-9, 9, (rows, dim)) / 4
    v[: rows // 3] = v[0]
    ids = [None if i % 50 == 49 else int(i // 2 if i > rows - 20 else i) for i in range(rows)]
    labels = [None if i % 9 == 0 else i % 4 for i in range(rows)]
    bad = [(1, 0, None), (2, 0, []), (3, 1, [None] * dim), (4, 1, [float("inf")] * dim), (5, 1, [1.0])]
    df = spark.createDataFrame([(i, l, x.tolist()) for i, l, x in zip(ids, labels, v)] + bad, "vec_id long, label int, embedding array<double>").withColumn("PACK", F.lit(1)).withColumn("Codes", F.lit(1)).repartition(5)
    made, book = codes.compress(df, scale=4.0)
    found = codes.with_label_error(made).collect()
    x = np.floor(np.pad(v, ((0, 0), (0, -dim % 8))) * 4).astype(np.int64).reshape(rows, 8, -1)
    order = sorted(range(rows), key=lambda i: (ids[i] is None, ids[i] or 0, (v[i] * 4).tolist()))[:16]
    expected, code, error = lloyd(x, x[order], 6)
    assert (book == expected).all()
    sums = {l: sum(int(e) for e, m in zip(error, labels) if m == l) for l in set(labels)}
    rows_ = [(i, l, bytes(c.tolist()), int(e), sums[l]) for i, l, c, e in zip(ids, labels, code, error)]
    assert sorted(map(str, ((a.vec_id, a.label, bytes(a.codes), a.error, a.label_error) for a in found))) == sorted(map(str, rows_))


def test_rounds_join_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "PACK", 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, 0, [float(i % 7)] * 8) for i in range(200)], "vec_id long, label int, embedding array<double>")
        made, _ = codes.compress(df, rounds=2)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert made.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rows(spark):
    df = spark.createDataFrame([(1, 0, None)], "vec_id long, label int, embedding array<double>")
    made, book = codes.compress(df)
    assert made.count() == 0 and book.size == 0 and codes.with_label_error(made).count() == 0
