"""The first-wins rule against a plain walk, near copies without the square of them, and the index of accepted texts."""

import os
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import accepted as C
from millrace.operators import dedup as D
from millrace.sources.scratch import dropped, written


def near(a, b, t=0.85):
    return bool(a and b) and len(a & b) / len(a | b) >= t


def walked(rows, t=0.85):
    """{row: reason} of (row, seq, scope, text, eligible) in the order of seq, nulls last, then row."""
    kept, out = [], {}
    for row, seq, scope, text, fits in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        words = frozenset((text or "").split())
        others = [(w, x) for s, w, x in kept if s == scope and (x == (text or "") or near(w, words, t) or (w == words and w))]
        # The reason is exact only for the kept row that has the same word set.
        out[row] = None if not others else "exact_duplicate" if any(x == (text or "") for _, x in others) else "semantic_similarity"
        if fits and not others:
            kept.append((scope, words, text or ""))
    return out


def made(seed, n=120):
    r = np.random.default_rng(seed)
    base = [list(r.choice(40, 14, replace=False)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(base[r.integers(0, 12)])
        for _ in range(r.integers(0, 3)):
            words[r.integers(0, len(words))] = int(r.integers(0, 60))
        text = " ".join(f"w{x}" for x in words)
        rows.append((i, None if r.random() < 0.05 else int(r.integers(0, n)), "a" if r.random() < 0.8 else "b", None if r.random() < 0.03 else text if r.random() > 0.03 else "", bool(r.random() < 0.7)))
    return rows


@pytest.mark.parametrize("seed,first,small", [(0, None, None), (1, 2, None), (2, 1, 0), (3, 3, 5)])
def test_first_wins(spark, monkeypatch, seed, first, small):
    """All at once; in rounds of growing limits; settled by rounds instead of one task."""
    if first:
        monkeypatch.setattr(D, "MOST_PAIRS", 0)
        monkeypatch.setattr(D, "PAIRS_A_ROW", 0.01 if seed == 1 else 0.5)
        monkeypatch.setattr(D, "FIRST", first)
        monkeypatch.setattr(D, "GROWTH", 2)
    if small is not None:
        monkeypatch.setattr(D, "SMALL", small)
    rows = made(seed)
    df = spark.createDataFrame(rows, "row long, seq long, scope string, text string, eligible boolean").withColumn("text", F.coalesce("text", F.lit("")))
    got = {r.row: r.reason for r in D.first_wins(df, 0.85).collect()}
    assert got == walked(rows)
    assert {None, "exact_duplicate", "semantic_similarity"} <= set(got.values())


def test_rows_without_or_with_one_seq(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c d"), (2, None), (3, ""), (None, "x y z")]
    df = spark.createDataFrame(rows, "seq long, text string").coalesce(1)
    got = sorted(map(str, D.first_wins_dedup(df).select("seq", "text", "reason").collect()))
    assert len(got) == 6
    assert got == sorted(map(str, [r for r in spark.createDataFrame([(1, "a b c", None), (1, "a b c", "exact_duplicate"), (None, "a b c d", None), (2, None, None), (3, "", "exact_duplicate"), (None, "x y z", None)], "seq long, text string, reason string").collect()]))


def test_near_copies_are_linear(spark, monkeypatch):
    """20,000 texts that differ in one word: their pairs would be 200 million."""
    written, sizes = D.written, []

    def counted(df, name):
        out = written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(D, "written", counted)
    common = " ".join(f"c{i}" for i in range(20))
    df = spark.range(20_000).select(F.col("id").alias("seq"), F.concat(F.lit(common + " u"), "id").alias("text")).repartition(8)
    got = D.first_wins_dedup(df).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {None: 1, "semantic_similarity": 19_999}
    assert max(sizes) < 20_000 * 16
    led = D.near_duplicate_pairs(df, pairs=False)
    assert led.count() == 19_999 and led.agg(F.min("a"), F.max("a")).first() == (0, 0)


def test_leader_pairs(spark):
    rows = [(i, None, "a", t, True) for i, _, _, t, _ in made(7)]
    df = spark.createDataFrame([(r[0], r[3] or "") for r in rows], "seq long, text string")
    sets = {i: frozenset((t or "").split()) for i, _, _, t, _ in rows}
    every = D.near_duplicate_pairs(df).collect()
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(sets[i], i)
    names = sorted(firsts.values())
    assert sorted((r.a, r.b) for r in every) == [(a, b) for a in names for b in names if a < b and near(sets[a], sets[b])]
    kept = []
    for i in names:
        if not any(near(sets[i], sets[k]) for k in kept):
            kept.append(i)
    expected = {i: next(k for k in kept if near(sets[i], sets[k])) for i in names if i not in kept}
    assert {r.b: r.a for r in D.near_duplicate_pairs(df, pairs=False).collect()} == expected


def test_segments():
    index = C.AcceptedIndex.__new__(C.AcceptedIndex)
    for n in range(300):
        found = index.segments(n)
        assert [x for a, b in found for x in range(a, b)] == list(range(n)) and len(found) <= 3 * 5


def files(df):
    return len(df.inputFiles())


def test_index_reads_no_more_as_it_grows(spark, tmp_path):
    """Every batch reads the partitions of its own words: some in each of few segments."""
    index = C.AcceptedIndex(spark, f"file://{tmp_path}/index", buckets=4)
    text = lambda k: " ".join(f"b{k}w{i}" for i in range(12))
    read = []
    only = C.AcceptedIndex._only

    def counted(self, table, buckets):
        out = only(self, table, buckets)
        read.append(files(out))
        return out

    C.AcceptedIndex._only = counted
    try:
        seen = {}
        for n in range(9):
            rows = spark.createDataFrame([(n, text(n))], "row long, text string")
            if n:
                old = spark.createDataFrame([(0, text(n - 1)), (1, text(n - 1) + " extra"), (2, text(n)), (3, None)], "row long, text string")
                read.clear()
                got = {r.row: r.reason for r in index.reasons(old, "row", n).collect()}
                assert got == {0: "exact_duplicate", 1: "semantic_similarity"}
                seen[n] = sum(read)
            index.append(rows, n)
            index.append(rows, n)  # a batch that runs again
        # Three reads of four partitions at most in each segment; segments are as few after four batches as after one, after eight as after two.
        assert all(n <= 3 * 4 * len(index.segments(k)) for k, n in seen.items()) and seen[4] < seen[3] and seen[8] < seen[7]
        assert sorted(f for f in os.listdir(tmp_path / "index") if f.startswith("sets")) == ["sets-0-4", "sets-4-8", "sets-8-9"]
    finally:
        C.AcceptedIndex._only = only


def test_against_a_table(spark):
    rows = made(9)
    new = spark.createDataFrame([(r[0], r[3]) for r in rows[:60]], "seq long, text string")
    old = spark.createDataFrame([(r[0], r[3]) for r in rows[60:]], "seq long, text string")
    texts = [(frozenset((r[3] or "").split()), r[3] or "") for r in rows[60:]]
    expected = {}
    for i, _, _, t, _ in rows[:60]:
        w = frozenset((t or "").split())
        expected[i] = "exact_duplicate" if any(x == (t or "") for _, x in texts) else "semantic_similarity" if any(near(w, o) for o, _ in texts) else None
    assert {r.seq: r.reason for r in C.dedup_against(new, old).collect()} == expected
    assert C.dedup_against(new, old.limit(0)).where("reason is not null").count() == 0
    assert C.dedup_against(new.limit(0), old).count() == 0


def test_writes_leave_no_shuffle_files(spark):
    """Neither shuffle files nor a mark of success, for which the driver starts a child; what is superseded goes at once."""
    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    there = lambda: {str(p) for p in local.rglob("shuffle_*.data")}
    before = there()
    made = written(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(100):
        if there() <= before:
            break
        time.sleep(0.1)
    folder = Path(made._scratch.removeprefix("file:"))
    assert there() <= before and made.count() == 7 and not (folder / "_SUCCESS").exists()
    dropped(made)
    assert not folder.exists()


def test_unlike_sets_meet_by_their_sketches(spark, monkeypatch):
    """Every near pair passes, and of the pairs of texts that share their rarest words only, no words are looked at."""
    r = np.random.default_rng(3)
    sets = {i: set(map(int, r.integers(-(2**63), 2**63 - 1, 60))) | {1, 2, 3} for i in range(40)}
    sets |= {40 + i: set(list(sets[i])[:-k]) | {900 + i} for i in range(20) for k in (i % 6 + 1,)}
    rows = spark.createDataFrame([(i, "", sorted(w)) for i, w in sets.items()], "cid long, scope string, words array<long>")
    truth = {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])}
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    passed = {(x.a, x.b) for x in D.may_reach(pairs, rows, rows, 0.85).collect()}
    assert truth <= passed and len(passed) < len(truth) + 10
    assert {(x.a, x.b) for x in D.set_pairs(rows, 0.85).collect()} == truth
    for few in (D.SMALL, 0):
        monkeypatch.setattr(D, "SMALL", few)
        assert {(x.a, x.b) for x in D.verified(pairs, rows, rows, 0.85).collect()} == truth
    order = D.frequent(rows.select(F.explode("words").alias("word")))
    assert set(order[-3:].tolist()) == {1, 2, 3}
    for x in D.prefixes(rows, 0.85).collect():
        assert x.n == len(sets[x.cid]) and x.at < x.n - int(np.ceil(0.85 * x.n - 1e-9)) + 1 and x.word in sets[x.cid] - {1, 2, 3}
