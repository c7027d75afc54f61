"""Streams: state that goes again, and rows that are null, late or out of order."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import augment as A
from millrace.sources import samples as S
from millrace.streaming import streams as X

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, parts, bucket):
    """(rows of all micro-batches, keys in the state after each)."""
    source, out, keys = f"{tmp_path}/source", f"{tmp_path}/out", []
    for n, part in enumerate(parts):
        rows = [(i, k, START + dt.timedelta(seconds=s) if s is not None else None, t) for i, k, s, t in part]
        spark.createDataFrame(rows, "event_id long, key string, ts timestamp, tokens double").coalesce(1).write.mode("append").parquet(source)
        made = X.stream_token_bucket(spark.readStream.schema("event_id long, key string, ts timestamp, tokens double").parquet(source), *bucket, late="10 seconds")
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        made.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "bucket").load()
        keys.append(sorted(r[0] for r in state.select("key.key").distinct().collect()))
    return spark.read.parquet(f"{out}/batch=*"), keys


def test_idle_buckets_go(spark, tmp_path):
    parts = [[(1, "a", 0, 50.0), (2, "a", 1, None), (3, "a", 2, 50.0), (4, "b", 0, 1.0)], [(5, "b", 1000, 1.0)], [(6, "b", 1030, 1.0), (7, "a", 1030, 60.0)], [(8, "b", 1031, float("nan")), (9, "c", 1031, 61.0)]]
    found, keys = run(spark, tmp_path, parts, (9, 1.0, 60, 1.0))
    got = {r.event_id: (r.admitted, r.token_level) for r in found.collect()}
    assert got == {1: (True, 10.0), 2: (True, 11.0), 3: (False, 12.0), 4: (True, 59.0), 5: (True, 59.0), 6: (True, 59.0), 7: (True, 0.0), 8: (True, 60.0), 9: (False, 60.0)}
    # After the second batch the watermark is at 990 s: "a" would be full again.
    assert keys[0] == ["a", "b"] and "a" not in keys[1]


def test_parts_keep_the_order(spark):
    texts = ["x" * n for n in (10, 0, 30, 500, 3, 3, 3, 3, 90, 20)]
    rows = [(i, str(i), j, t, 1) for j in ("p", None) for i, t in enumerate(texts)] + [(99, "99", "q", None, None)]
    df = spark.createDataFrame(rows, "seq long, id string, job_id string, text string, tokens_estimated int").repartition(3)
    for most, size in ((3, 1 << 20), (1000, 100), (2, 60)):
        made = S.assemble_parts(df, ["job_id"], rows=most, size=size).collect()
        for job in ("p", None, "q"):
            parts = sorted((r for r in made if r.job_id == job), key=lambda r: r.part)
            assert [r.part for r in parts] == list(range(len(parts)))
            assert [s.seq for r in parts for s in r.samples] == ([99] if job == "q" else list(range(len(texts))))
            assert {r.total_samples for r in parts} == {1 if job == "q" else 10}
            for r in parts:
                assert len(r.samples) <= most and (len(r.samples) == 1 or sum(len(s.text or "") for s in r.samples) <= size)


def test_a_hot_job_is_ranked_in_ranges(spark):
    rows = [(i, "hot") for i in range(1000)] + [(i, f"j{i % 30}") for i in range(60)] + [(5, None)]
    df = spark.createDataFrame(rows, "seq long, job string").repartition(5)
    for ratio in (0.3, 1.0, 0.001, 0.0):
        got = A.select_for_augmentation(df, ratio, ["job"]).collect()
        expected = []
        for job in {r[1] for r in rows}:
            mine = sorted(s for s, j in rows if j == job)
            expected += [(s, job) for s in mine[: min(len(mine), max(1, int(len(mine) * ratio))) if ratio > 0 else 0]]
        assert sorted(map(str, ((r.seq, r.job) for r in got))) == sorted(map(str, expected))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chosen = A.select_for_augmentation(df, 0.9, ["job"])
        assert chosen.where("job = 'hot'").count() == 900
        assert A.select_for_augmentation(df.limit(0), 0.5, ["job"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
