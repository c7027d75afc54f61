"""Results of jobs of any size."""

from pyspark.sql import functions as F

from millrace.plans import queries
from millrace.sources.samples import assemble_parts, flatten_results

HOME = "/root/testdata/sf0.001"


def test_a_large_job_takes_several_rows(spark):
    rows = [(i, str(i), None if i % 5 == 0 else "hot", "x" * (i % 50), 2) for i in range(5_000)] + [(9_000, "a", "small", None, 2), (9_001, "b", "big", "y" * 5_000, 2), (9_002, "c", "big", "z" * 5_000, 2)]
    df = spark.createDataFrame(rows, "seq long, id string, job_id string, text string, tokens_estimated int")
    made = assemble_parts(df, ["job_id"], rows=100, size=1 << 16)
    assert made.agg(F.max(F.size("samples"))).first()[0] < 200
    assert {(r.job_id, r.total_samples, r.total_tokens_estimated) for r in made.collect()} == {("hot", 4_000, 8_000), (None, 1_000, 2_000), ("small", 1, 2), ("big", 2, 4)}
    flat = flatten_results(made.select("job_id", F.to_json(F.struct("samples", "total_samples")).alias("result"))).collect()
    assert sorted((str(r.job_id), r.sample_id, str(r.text)) for r in flat) == sorted((str(x[2]), x[1], str(x[3])) for x in rows)


def test_s2_parts_and_s3_without_texts(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "assemble_results", lambda df, *a, f=queries.assemble_results: asked.append(df.columns) or f(df, *a))
    queries.QUERIES["s2_flatten_results"](spark, HOME)
    assert asked == []
    queries.QUERIES["s3_assemble_results"](spark, HOME)
    assert len(asked) == 1 and "text" not in asked[0]
