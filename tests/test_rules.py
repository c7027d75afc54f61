"""Aspects, alternatives, running totals, rejected rows and job times against plain rules."""

import datetime as dt
import json
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import augment as A
from millrace.operators import dedup as D
from millrace.operators import jobs as J
from millrace.operators import prompts as P
from millrace.sources import samples as S

ODD = ["", "Acme Phone X is Great", "acme phone", "ABC abc1 naïve Foo_bar  Zed\tYan\n Xu", "ſervice K app's APP", "x" * 3000, "Ab " * 4000, "aé Ab", "prices priced Displayed customerservice", "Hello World. The New York-based Co app-store", "a bb a cc dd", "Foo Bar Baz"]


def aspects(text, lexicon, mode):
    """The rule as written: terms in the lower-case text, and two patterns over the text, whose case counts in the strict mode for capitalised words."""
    found = {a for a in lexicon if a in text.lower()}
    found |= {m.lower() for m in re.findall(r"\b(?:app|software|device|product|service|system|platform)\b", text, re.IGNORECASE)}
    if mode:
        found |= {m.lower() for m in re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text, re.IGNORECASE if mode == "compat" else 0)}
    return sorted(found, key=lambda x: x.encode())


@pytest.mark.parametrize("mode", [True, "compat", False])
def test_aspects(spark, mode):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t for t in texts if t and (mode != True or len(t) < 20_000)] + (ODD if mode == "compat" else [t for t in ODD if len(t) < 5000])  # noqa: E712
    lexicon = [*A.ASPECTS, "pric", "prices", "ser", "th", "the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", A.extract_aspects(F.col("text"), lexicon, mode).alias("x"))
    for r in df.collect():
        assert r.x == aspects(texts[r.i], lexicon, mode), texts[r.i][:80]


def test_terms(spark):
    found = spark.range(1).select(F.array_sort(A.terms_in(F.lit("a.b+c ab abc"), ["a.b", "ab", "abc", "bc", "+c", "zz", ""])).alias("x")).first().x
    assert sorted(set(found)) == sorted(["a.b", "ab", "abc", "bc", "+c"])
    assert spark.range(1).select(A.terms_in(F.lit("abc"), []).alias("x")).first().x == []


def ada(spark, samples, table, n):
    similarity = samples.select("sample_id").withColumn("strategy", F.lit("ADA")).withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("response", F.lit("1.0"))
    alternatives = spark.createDataFrame(table, "aspect string, product string, alternative string, rank int")
    return sorted((r.sample_id, r.variant_index, r.variant) for r in A.ada_variants(samples, alternatives, similarity, n, ["price", "size"], proper=False).collect())


def test_alternatives_come_round_by_product(spark):
    samples = spark.createDataFrame([("1", "the price is high", "pen"), ("2", "the price is high", "cup"), ("3", "price and size", None)], "sample_id string, text string, product string")
    table = [("price", None, "fee", 2), ("price", None, '"Cost"', 1), ("price", None, "price", 0), ("price", "pen", "tariff", 1), ("price", "pen", "charge", 2), ("price", "pen", "rate", 3), ("size", "cup", "volume", 1)]
    assert ada(spark, samples, table, 4) == [
        ("1", 0, "the tariff is high"), ("1", 1, "the charge is high"), ("1", 2, "the rate is high"), ("1", 3, "the tariff is high"),
        ("2", 0, "the cost is high"), ("2", 1, "the fee is high"), ("2", 2, "the cost is high"), ("2", 3, "the fee is high"),
        ("3", 0, "cost and size"), ("3", 2, "fee and size"),
    ]
    distinct = [v for s, i, v in ada(spark, samples, table, 3) if s == "1"]
    assert len(distinct) == len(set(distinct)) == 3
    assert ada(spark, samples.drop("product"), table, 2) == [("1", 0, "the cost is high"), ("1", 1, "the fee is high"), ("2", 0, "the cost is high"), ("2", 1, "the fee is high"), ("3", 0, "cost and size")]


def test_running_totals(spark):
    df = spark.range(30_000).select(F.col("id"), F.concat(F.lit("Text "), F.col("id") % 20_000, F.when(F.col("id") % 2 == 0, "!").otherwise("")).alias("text"))
    whole = D.dedup_state(df)
    parts = D.dedup_state(df.withColumn("b", F.col("id") % 7), ["b"])
    merged = D.merge_states(D.merge_states(parts.where("b < 3").drop("b")).unionByName(D.merge_states(parts.where("b >= 3").drop("b"))))
    one, other = (D.state_totals(x).first() for x in (whole, merged))
    assert tuple(one) == tuple(other) and one["rows"] == 30_000
    exact = D.dedup_stats(df).first()
    assert exact == (20_000, 20_000)
    assert all(abs(x / 20_000 - 1) < 4 * 1.04 / 2**7 for x in (one.total_seen, one.unique_normalized))


def test_rejected_rows(spark, tmp_path):
    row = {"seq": 1, "id": "a", "product": "p", "prompt_version": "v1", "generated_at": "2024-01-01T00:00:00Z", "text": "t", "tokens_estimated": 3, "temperature": 0.5}
    lines = [json.dumps(row), json.dumps(row | {"tokens_estimated": -1}), json.dumps(row)[:20], json.dumps(row | {"tokens_estimated": "many"}), json.dumps({k: v for k, v in row.items() if k != "text"} | {"id": None}), "", "nonsense"]
    (tmp_path / "x.json").write_text("\n".join(lines))
    good, bad = S.checked_samples(spark, str(tmp_path / "x.json"))
    assert [r.id for r in good.collect()] == ["a"] and good.columns == [f.split()[0] for f in S.SAMPLE.split(", ")]
    assert sorted((r.raw, r.reasons) for r in bad.collect()) == sorted([(lines[1], ["tokens_estimated below 0"]), (lines[2], ["not readable"]), (lines[3], ["not readable"]), (lines[4], ["missing id", "missing text"]), ("nonsense", ["not readable"])])
    S.write_samples(good.unionByName(good.withColumn("tokens_estimated", F.lit(-2))), str(tmp_path / "p"))
    good, bad = S.checked_samples(spark, str(tmp_path / "p"), "parquet")
    assert good.count() == 1 and bad.select(F.element_at("reasons", 1)).first()[0] == "tokens_estimated below 0"
    S.write_samples(good, str(tmp_path / "j"), "json")
    assert S.checked_samples(spark, str(tmp_path / "j"))[0].first().prompt_version == "v1"


def test_requests_without_a_number(spark):
    rows = spark.createDataFrame([("pen", None, "v1", 0.5), ("pen", 3, "v1", None), ("pen", 3, "v1", 0.5)], "product string, count int, version string, temperature double")
    rows = rows.withColumns({"prompt": F.lit("p"), "model": F.lit("gpt-4")})
    pricing = spark.createDataFrame([("gpt-4", 0.03, 0.06)], "model string, prompt_per_1k double, completion_per_1k double")
    assert sorted(r.errors for r in P.validate_requests(rows, pricing).collect()) == [[], ["count"], ["temperature"]]


def test_job_times(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", at(1), "STARTED", None, None), ("a", at(5), "SUCCESS", at(0), at(4)), ("b", at(2), "STARTED", None, None), ("b", at(3), "PROGRESS", None, None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "job_id string, ts timestamp, state string, started_at timestamp, completed_at timestamp, error string")
    got = {r.job_id: (r.created_at, r.updated_at) for r in J.latest_job_status(df).collect()}
    assert got == {"a": (at(0), at(4)), "b": (at(2), at(3))}
    got = {r.job_id: (r.created_at, r.updated_at) for r in J.latest_job_status(df.drop("started_at", "completed_at")).collect()}
    assert got == {"a": (at(1), at(5)), "b": (at(2), at(3))}
