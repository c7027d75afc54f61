"""Small edge cases with known answers; the queries themselves are held against SQL in test_queries."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import requests as R
from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.operators import augment as A
from millrace.operators import dedup as D
from millrace.operators import packing as K
from millrace.operators import prompts as P
from millrace.operators import quality as Q
from millrace.operators import usage as U
from millrace.plans import queries


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text_counts_keep_empty_tails(spark):
    r = spark.range(1).select(*T.text_counts(F.lit("A. B."))).first()
    assert (r.word_count, r.char_count, r.sentence_count) == (2, 5, 3)
    assert one(spark, T.normalize_text(F.lit("  Héllo,  WORLD! "))) == "héllo world"
    assert one(spark, T.word_count(F.lit(""))) == 0


def test_scores(spark):
    assert [one(spark, S.length_score(F.lit(n))) for n in (9, 10, 20, 30, 50, 200, 201, 301, 500, 501)] == [0.2, 0.4, 0.6, 0.8, 1.0, 1.0, 0.8, 0.6, 0.4, 0.2]
    assert [one(spark, S.parse_score(F.lit(x).cast("string"), 0.7)) for x in ("0.9", "Score: 7", "n/a", None)] == [0.9, 1.0, 0.7, 0.7]
    assert one(spark, S.grammar_score(F.lit("a a a a a a ."))) == 1 - 2 / 3
    assert one(spark, S.diversity_score(F.lit("one"))) == 0.0


def test_first_wins_is_not_transitive(spark):
    """A is near B and B near C, but A is not near C: A and C stay. A copy of a rejected row is no duplicate."""
    words = [f"w{i}" for i in range(20)]
    a, b, c = " ".join(words), " ".join(words[1:] + ["x"]), " ".join(words[2:] + ["x", "y"])
    rows = spark.createDataFrame([(1, a, "j"), (2, b, "j"), (3, c, "j"), (4, a, "k"), (5, "", "j"), (6, "!", "j"), (7, a.upper(), "j")], "seq long, text string, job string")
    got = {r.seq: r.reason for r in D.first_wins_dedup(rows, 0.85, ["job"]).collect()}
    assert got == {1: None, 2: "semantic_similarity", 3: None, 4: None, 5: None, 6: "exact_duplicate", 7: "exact_duplicate"}
    marked = rows.select("seq", F.lit("").alias("scope"), "text", (F.col("seq") > 1).alias("eligible"))
    again = {r.seq: r.reason for r in D.first_wins(marked, 0.85).collect()}
    assert again[1] is None and again[2] is None and again[3] == "semantic_similarity" and again[4] == "semantic_similarity"
    assert D.first_wins_dedup(rows.limit(0), 0.85).count() == 0


def test_a_long_chain_settles(spark, monkeypatch):
    """Each text is near to the three before it only: every fourth stays, by one task's walk and by rounds."""
    chain = lambda n: spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(n)], "seq long, text string")
    kept = lambda n: sorted(r.seq for r in D.first_wins_dedup(chain(n)).where("reason is null").collect())
    assert kept(300) == list(range(0, 300, 4))
    monkeypatch.setattr(D, "SMALL", 3)
    assert kept(20) == list(range(0, 20, 4))


def test_quality_filter_of_the_issue_samples(spark):
    good = "The widget works very well for me and I recommend it because its quality is great, honestly, every day now."
    rows = spark.createDataFrame([(1, "Too short.", "widget", "review", 5), (2, good, "widget", "review", 100)], "seq long, text string, product string, template_type string, tokens_estimated int").withColumn("id", F.col("seq").cast("string"))
    out = Q.quality_filter(rows, Q.FilterConfig(min_overall_score=0.3))
    assert {r.seq: r.status for r in out.collect()} == {1: "failed_length", 2: "passed"}
    assert Q.filter_stats(out).first().total_processed == 2


def test_costs_and_requests(spark):
    assert abs(one(spark, R.cost(F.lit(100), F.lit(200), F.lit(0.03), F.lit(0.06))) - 0.015) < 1e-9
    assert one(spark, R.sanitize_product(F.lit(" a<b>#c ! "))) == "abc !"
    assert [one(spark, R.backoff_delay(F.lit(n))) for n in (0, 1, 3, 9)] == [0.0, 1.0, 4.0, 60.0]
    assert [one(spark, R.length_constraint(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((1, 2), (0, 2), (3, None), (None, 0))] == ["between 1-2 words", "no more than 2 words", "at least 3 words", ""]
    rows = spark.createDataFrame([(1, 0), (2, 2)], "request_id long, count int")
    assert P.expand_requests(rows).count() == 2


def test_replacement_takes_text_as_it_is(spark):
    assert one(spark, A.replace_aspect(F.lit("The cat, the CAT; cats"), F.lit("cat"), F.lit("a$1\\b"))) == "The a$1\\b, the a$1\\b; cats"
    assert one(spark, A.extract_aspects(F.lit("New York price of this App"))) == ["app", "new york", "price"]
    assert one(spark, A.identify_changes(F.lit("a b"), F.lit("b c"), F.array())) == ["added: c", "removed: a"]


def test_reset_durations(spark):
    assert [one(spark, U.parse_reset_duration(F.lit(x))) for x in ("6m0s", "1h", "", "500ms", "2x")] == [360, 3600, 0, 30000, 0]


def test_fold_carries_state_over_batches(spark):
    """A key of 2,500 rows over Arrow batches of 100 equals a plain walk."""
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "k", at + dt.timedelta(seconds=i), float(i % 5)) for i in range(2500)], "event_id long, key string, ts timestamp, tokens double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {r.event_id: r.batch_id for r in K.pack_batches(rows, 7, 12).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch, n, s = 0, 0, 0.0
    for i in range(2500):
        if n >= 7 or s >= 12:
            batch, n, s = batch + 1, 0, 0.0
        n, s = n + 1, s + i % 5
        assert got[i] == batch


def test_trailing_usage_of_a_hot_key(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "k", at + dt.timedelta(seconds=20 * i), 1.0) for i in range(50)], "event_id long, key string, ts timestamp, tokens double")
    got = {r.event_id: r.requests_in_window for r in U.trailing_usage(rows, 60).collect()}
    assert got == {i: min(i + 1, 3) for i in range(50)}


def test_sliding_windows_of_usage(spark):
    from millrace.streaming import streams

    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "k", at + dt.timedelta(seconds=20 * i), 1.0) for i in range(6)], "event_id long, key string, ts timestamp, tokens double")
    got = {int((r.start - at).total_seconds()): r.requests for r in streams.stream_usage(rows, "60 seconds", "30 seconds").collect()}
    assert got == {-30: 2, 0: 3, 30: 3, 60: 3, 90: 1}


def test_jitter_spreads_a_tenth_either_way(spark):
    waits = lambda j: [one(spark, R.backoff_delay(F.lit(n), jitter=F.lit(j))) for n in (0, 1, 3, 9)]
    assert np.allclose(waits(0.0), [0, 0.9, 3.6, 54]) and np.allclose(waits(0.5), [0, 1, 4, 60]) and np.allclose(waits(1.0), [0, 1.1, 4.4, 66])


def test_generate_takes_a_function(spark):
    prompts = spark.createDataFrame([(1, "a b", 0.5, 3), (2, "c", 0.5, 3)], "request_id long, prompt string, temperature double, max_tokens int")

    def shout(batches):
        for batch in batches:
            yield batch.assign(text=batch.prompt.str.upper())[["request_id", "text"]]

    assert {r.request_id: r.text for r in P.generate(prompts, shout, "request_id long, text string").collect()} == {1: "A B", 2: "C"}
    assert all(len(r.text.split()) <= 3 for r in P.generate(prompts).collect())


def test_proper_nouns_are_aspects(spark):
    text = "We met Anna Smith in Paris. The price of the Acme Phone was fine"
    found = one(spark, A.extract_aspects(F.lit(text)))
    assert {"anna smith", "acme phone", "price"} <= set(found) and "met" not in found
    assert "anna smith" not in one(spark, A.extract_aspects(F.lit(text), proper=False))


def test_filter_holds_batches_against_accepted_texts(spark, tmp_path):
    """Three micro-batches: an equal, a near and a new text in each later one; a text near to an accepted one does not hide others of its batch."""
    from millrace.streaming import streams

    config = Q.FilterConfig(min_overall_score=0.0)
    text = lambda *own: " ".join([f"w{i}" for i in range(30)] + list(own))
    parts = [[(1, text("a", "b"))], [(2, text("A", "b.")), (3, text("a", "c")), (4, " ".join(f"v{i}" for i in range(20)))], [(5, " ".join(f"v{i}" for i in range(1, 21))), (6, " ".join(f"v{i}" for i in range(4, 24)))]]
    source, out = str(tmp_path / "source"), str(tmp_path / "accepted")
    for part in parts:
        rows = spark.createDataFrame(part, "seq long, text string").withColumns({"product": F.lit("p"), "template_type": F.lit("review")})
        rows.coalesce(1).write.mode("append").parquet(source)
        streams.stream_quality_filter(spark.readStream.schema(rows.schema).parquet(source), out, str(tmp_path / "state"), config).awaitTermination()
    assert sorted((r.seq, r.batch_id) for r in spark.read.parquet(out).collect()) == [(1, 0), (4, 1), (6, 2)]


def test_moving_mean_of_a_hot_key_over_many_stretches(spark):
    """Leading zeros, a run of zeros long enough to underflow, and one key over several partitions, against a plain walk."""
    at, rng = dt.datetime(2024, 1, 1), np.random.default_rng(1)
    x = np.round(rng.random(20_000) * 9, 3)
    x[:30] = 0
    x[4_000:13_000] = 0
    rows = [(i, "hot", at + dt.timedelta(seconds=i), float(v)) for i, v in enumerate(x)] + [(30_000 + i, None if i % 2 else "k", at, float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, latency double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {r.event_id: r.ema for r in U.ema_response_time(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for i, key, _, v in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        y = state.get(key, 0.0)
        state[key] = v if y == 0 else 0.1 * v + (1 - 0.1) * y
        assert abs(got[i] - state[key]) < 1e-9, i


def test_a_quote_at_one_end_stays(spark):
    """Only a pair around the whole answer goes: the words but the last of a text may end with a quote of their own."""
    texts = {' "new a" ': "new a", 'token = "4d"': 'token = "4d"', '"new token = "4d"" ': 'new token = "4d"', '"': '"', '""': "", '"a\nb"\n': "a\nb"}
    assert [one(spark, A.unwrapped(F.lit(x))) for x in texts] == list(texts.values())


def test_quotes_of_the_variants(spark, tmp_path):
    """The queries' variants are the words that their SQL takes, whatever quotes these begin or end with."""
    texts = ['b the "c" d', '"b" the "c" d', '"', '"the', '"the" x', 'the "x']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("s"), "n_chars": F.length("text")})
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.sample_id, r.variant_index): r.variant for r in queries.paraphrases(spark, str(tmp_path)).collect()}
    assert got == {(str(i), 0): " ".join(x.split()[:-1]) for i, x in enumerate(texts)} | {(str(i), 1): f"new {x}" for i, x in enumerate(texts) if i % 2 == 0}


def test_trailing_windows(spark):
    """Against brute force: ties, rows without a time (peers of each other), nulls, and large values that leave no trace behind. No frame slides: a window of many rows is not summed anew."""
    r = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    seconds = [None if x < 5 else float(x) / 4 for x in r.integers(0, 900, 400)]
    rows = [(i, "ab"[i % 2], None if s is None else start + dt.timedelta(seconds=s), [None, 1.25, 1e18, 7.0, 0.5][int(r.integers(0, 5))] if i % 7 else None) for i, s in enumerate(seconds)]
    made = U.trailing_usage(spark.createDataFrame(rows, "event_id long, key string, ts timestamp, tokens double"), 10)
    for x in made.collect():
        held = [t for _, k, ts, t in rows if k == x.key and (ts is None if x.ts is None else ts is not None and dt.timedelta(0) <= x.ts - ts < dt.timedelta(seconds=10))]
        known = [t for t in held if t is not None]
        assert x.requests_in_window == len(held) and x.tokens_in_window == (sum(sorted(known)) if known else None)
    assert made.count() == len(rows)
    frames = made._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding" in frames and frames.count("specifiedwindowframe") == frames.count("unboundedpreceding")


def test_answers_meet_their_variants(spark):
    """Answers join by sample alone, with what a join by all keys gives: none, several, other strategies, null keys; the variants' plan deals no row by more than its sample."""
    rows = spark.createDataFrame([("1", "CDA", 0, "x", ["x"]), ("1", "CDA", 1, "y", ["x"]), ("1", None, 0, "x", ["x"]), ("2", "CDA", 0, "x", ["x"]), (None, "CDA", 0, "x", ["x"])], "sample_id string, strategy string, variant_index int, variant string, aspects array<string>")
    answers = spark.createDataFrame([("1", "CDA", 0, "0.9"), ("1", "CDA", 0, "0.7"), ("1", "ADA", 1, "0.1"), ("1", None, 0, "0.2"), (None, "CDA", 0, "0.3")], "sample_id string, strategy string, variant_index int, response string")
    made = A.validate_variants(rows, answers)
    assert made.columns == [*rows.columns, "score", "is_valid"]
    got = sorted((x.sample_id or "", x.strategy or "", x.variant_index, round(x.score, 6)) for x in made.collect())
    assert got == [("", "CDA", 0, 0.75), ("1", "", 0, 0.75), ("1", "CDA", 0, 0.85), ("1", "CDA", 0, 0.95), ("1", "CDA", 1, 0.25), ("2", "CDA", 0, 0.75)]
    assert "strategy" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x.lower())
