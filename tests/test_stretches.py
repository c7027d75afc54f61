"""Packing and token buckets against plain walks, with a hot key that lies in many tasks and in many blocks."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import buckets as B
from millrace.operators import packing as K

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def many(spark):
    """Ranges stay as they are cut, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def log(spark, rows):
    return spark.createDataFrame([(i, k, START + dt.timedelta(seconds=s) if s is not None else None, t) for i, (k, s, t) in enumerate(rows)], "event_id long, key string, ts timestamp, tokens double").withColumn("_n", F.lit(1)).drop("_n")


def cost(t):
    return 0.0 if t is None or math.isnan(t) else t


def by_key(rows):
    """{key: [(id, second, cost)] in order}."""
    out = {}
    for i, (k, s, t) in enumerate(rows):
        out.setdefault(k, []).append((i, s, cost(t)))
    return {k: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[0])) for k, v in out.items()}


def packed(rows, most, limit, wait=None):
    out = {}
    for own in by_key(rows).values():
        batch, size, held, since = 0, 0, 0.0, None
        for i, s, t in own:
            if size >= most or held >= limit or (wait is not None and size and None not in (s, since) and s - since >= wait):
                batch, size, held = batch + 1, 0, 0.0
            since = s if not size else since
            size, held, out[i] = size + 1, held + t, batch
    return out


def walked(rows, sizes, rates):
    out = {}
    for own in by_key(rows).values():
        last, now = None, list(sizes)
        for i, s, t in own:
            pause = 0.0 if last is None or s is None else s - last
            last = s if s is not None else last
            now = [min(c, x + pause * r) for c, x, r in zip(sizes, now, rates)]
            fits = [now[0] >= 1, now[1] >= t]
            now = [now[0] - fits[0], now[1] - (t if fits[1] else 0.0)]
            out[i] = (all(fits), *now)
    return out


def made_rows(seed, n=1500, gap=3):
    r = np.random.default_rng(seed)
    keys = ["hot" if r.random() < 0.8 else (None if r.random() < 0.3 else f"k{r.integers(0, 40)}") for _ in range(n)]
    seconds = np.cumsum(r.integers(0, gap, n) + (r.random(n) < 0.01) * 40)
    tokens = r.choice([None, float("nan"), 0.0, 1.0, 2.0, 3.5, 9.0, 30.0], n)
    order = r.permutation(n)
    return [(keys[i], int(seconds[i]) if seed != 2 or i > 5 else None, tokens[i]) for i in order]


@pytest.mark.parametrize("seed,most,limit", [(0, 7, 12.0), (1, 1, 5.0), (2, 10, 1e9), (3, 400, 25.0), (4, 3, 0.5), (5, 2000, 1e9)])
def test_packing(many, seed, most, limit):
    rows = made_rows(seed)
    got = K.pack_batches(log(many, rows), most, limit)
    assert got.columns == ["event_id", "key", "ts", "tokens", "batch_id"]
    assert {r.event_id: r.batch_id for r in got.collect()} == packed(rows, most, limit)


@pytest.mark.parametrize("seed,most,limit,wait", [(0, 10, 40.0, 5), (2, 400, 1e9, 30), (6, 10, 12.0, 0.5)])
def test_packing_releases_what_has_waited(many, seed, most, limit, wait):
    rows = made_rows(seed, gap=4)
    assert {r.event_id: r.batch_id for r in K.pack_batches(log(many, rows), most, limit, wait).collect()} == packed(rows, most, limit, wait)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.0, 7.0]), min_size=1, max_size=40), st.integers(1, 9), st.sampled_from([0.5, 3.0, 8.0, 1e9]))
def test_links(tokens, most, limit):
    links, expected = K.Links(np.array(tokens), most, limit), packed([("a", i, t) for i, t in enumerate(tokens)], most, limit)
    begins = links.begins(0)
    assert (np.cumsum(begins) - 1).tolist() == [expected[i] for i in range(len(tokens))]
    assert links.hops[0] == begins.sum() - 1 and links.last[0] == np.flatnonzero(begins)[-1]
    for i in range(len(tokens)):
        own = links.begins(i)
        met, hops = links.meeting(begins)
        common = np.flatnonzero(own & begins)
        assert met[i] == (common[0] if len(common) else links.last[i]) and hops[i] == own[: met[i]].sum()


@pytest.mark.parametrize("seed,block,sizes,rates", [(0, 4096, (5.0, 30.0), (0.25, 1.0)), (1, 50, (5.0, 30.0), (0.125, 0.5)), (2, 16, (5.0, 64.0), (0.5, 2.0)), (3, 20, (3.0, 40.0), (0.0, 0.0)), (4, 30, (2.0, 10.0), (8.0, 64.0))])
def test_token_bucket(many, seed, block, sizes, rates, monkeypatch):
    """Rates are binary fractions, so that every sum is exact."""
    if seed == 1:
        monkeypatch.setattr(B, "PIECES", 3)  # blocks chained by their rows
    rows = made_rows(seed)
    got = B.token_bucket(log(many, rows), sizes[0], rates[0], sizes[1], rates[1], block=block)
    assert got.columns == ["event_id", "key", "ts", "tokens", "admitted", "request_level", "token_level"]
    assert {r.event_id: tuple(r)[4:] for r in got.collect()} == walked(rows, sizes, rates)


def test_a_null_does_not_fill_the_bucket(spark):
    got = B.token_bucket(log(spark, [("a", 0, 50.0), ("a", 1, None), ("a", 2, 50.0)]), 9, 0, 60, 0).orderBy("event_id").collect()
    assert [(r.admitted, r.token_level) for r in got] == [(True, 10.0), (True, 10.0), (False, 10.0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.5, 1.0, 4.0]), st.sampled_from([0.0, 1.0, 2.5, 7.0])), min_size=1, max_size=25), st.sampled_from([3.0, 8.0]))
def test_effects(rows, capacity):
    gains, costs = (np.array(x) for x in zip(*rows))
    made = B.effect(capacity, np.append(0.0, gains[1:]), costs)
    for level in np.arange(0, capacity + 0.25, 0.25):
        assert B.applied(capacity, {"low": None, "gains": gains, "costs": costs}, level) == B.applied(capacity, made, level)


def test_a_hot_key_is_many_tasks(many):
    rows = [("hot", i, float(i % 5)) for i in range(3000)]
    df = log(many, rows)
    for made in (K.pack_batches(df, 10, 8.0), B.token_bucket(df, 5, 0.25, 30, 1.0, block=100)):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 3 and max(sizes) < 1500
    assert K.pack_batches(df.limit(0)).count() == B.token_bucket(df.limit(0), 1, 1, 1, 1).count() == 0


@pytest.mark.parametrize("seed,rates,late", [(7, (0.002, 0.01), 0.37), (8, (0.1, 0.3), 1.0)])
def test_levels_round_as_in_a_plain_walk(many, seed, rates, late):
    """Rates that are no binary fractions: a hot key in many tasks and blocks, whose levels often equal a cost but for the last bits."""
    r = np.random.default_rng(seed)
    seconds = np.round(np.cumsum(r.integers(0, 200 if late < 1 else 9, 3000) * late), 6)
    rows = [("hot", float(s), float(t)) for s, t in zip(seconds, np.round(r.exponential(50 if late < 1 else 2, 3000), 2 if late < 1 else 1))]
    got = {x.event_id: tuple(x)[4:] for x in B.token_bucket(log(many, rows), 5, rates[0], 60, rates[1], block=64).collect()}
    last, requests, left = None, 5.0, 60.0
    for i, (_, s, t) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        us = round(s * 1e6)
        pause, last = (us - (us if last is None else last)) / 1e6, us
        requests, left = min(5.0, requests + pause * rates[0]), min(60.0, left + pause * rates[1])
        fits = (requests >= 1, left >= t)
        requests, left = requests - fits[0], left - (t if fits[1] else 0.0)
        assert got[i] == (all(fits), requests, left)
