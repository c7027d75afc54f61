"""Every operator and stage on nulls in any column, empty and very long texts, ties, repeated rows, an empty table and clashing column names."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, bpe, counts, langid, lm, mixing, simhash, suffixes, toxicity, vafile
from millrace.llm.entries import PIECES_32K, WORD_BPE

CLASH = ("key", "fp", "node", "name", "component_id", "least", "bins", "score", "lang_pred", "told", "ids", "bpe", "SIZE", "times", "target", "data", "spans", "n", "_id", "_text", "_keep", "rows", "counted", "kept", "docs", "word", "m", "_row")
LONG = " ".join(f"w{i % 977}x{i % 4001}" for i in range(60_000))
STORY = "the quiet harbour kept {} boats and every morning the old keeper counted them again before the fog came in from the sea"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [
        (None, None, None, None, None),
        (None, STORY.format("seven"), "en", None, 1),
        (None, "a row without an id that says something else entirely about mountains rivers and roads", "en", "s0", 1),
        (1, None, "en", "s0", None),
        (2, "", None, "s0", 0),
        (3, " \t\n", "en", None, 3),
        (4, LONG, "en", "s0", None),
        (5, STORY.format("nine"), "en", "s1", 1),
        (5, STORY.format("nine"), "en", "s1", 1),
        (5, STORY.format("nine"), "en", "s1", 1),
        (6, "el faro viejo guarda los barcos de la bahía y cuenta las olas cada noche sin dormir nunca", "es", "s1", 1),
        (6, "another text under the same id that shares no passage with the first one of that number", "en", "s1", 1),
        (7, "1234 567 !?", "es", "s0", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_search_operators(spark):
    rows = [(0, [1.0, 0.0], None), (0, [1.0, 0.0], None), (20, [1.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (None, [9.0, 9.0], "x"), (40, None, "x"), (4, [None, 1.0], "x"), (6, [float("inf"), 1.0], "x"), (60, [0.0, 0.0], "x"), (8, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, note string").select("*", *(F.lit(1).alias(c) for c in ("v", "q", "shard", "block", "score", "rank", "query_id", "dim", "n")))
    asked = F.col("vec_id") % 20 == 0
    near = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(df, asked).collect())
    assert near == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0)]
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.exact_top_k(df, asked).collect())
    assert [x for x in top if x[0] == 0] == [(0, 1, 2, 4096), (0, 2, 3, 4096), (0, 3, 20, 4096), (0, 4, 60, 0)]
    assert [x[2] for x in top if x[0] == 60] == [0, 2, 3, 20]


def test_text_operators_keep_rows_and_columns(spark, awkward):
    n, names = awkward.count(), awkward.columns
    model = langid.train(awkward)
    got = langid.identify(awkward, model)
    assert sorted(got.columns) == sorted(names) and got.count() == n
    assert {r.lang_pred for r in got.where("text is null or doc_id in (2, 3, 7)").collect()} == {"und"}
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1), (4, None), (2, 0), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    scored = toxicity.score(awkward, toxicity.train(awkward, labels))
    assert scored.count() == n and scored.where("score between 0 and 1").count() == n and sorted(scored.columns) == sorted(names)
    coded = bpe.encode(awkward, WORD_BPE, decoded="kept")
    assert coded.count() == n and sorted(coded.columns) == sorted(names)
    assert all((r.ids, r.kept) == ([], "") for r in coded.where("text is null or text = ''").collect())
    counted = counts.token_counts(awkward, PIECES_32K, name="n")
    assert {r.n for r in counted.where("text is null or doc_id in (2, 3)").collect()} == {0} and counted.count() == n
    for df in (awkward.limit(0), awkward.where("text is null")):
        assert langid.identify(df, langid.train(df)).where("lang_pred <> 'und'").count() == 0
        assert toxicity.score(df, toxicity.train(df, labels.limit(0))).where("score <> 0.5").count() == 0
        assert bpe.encode(df, WORD_BPE).where("size(ids) > 0").count() == 0 and counts.token_counts(df, PIECES_32K).where("n_tokens > 0").count() == 0


def test_lm(spark, awkward):
    model, words = lm.train(awkward, top=50)
    got = lm.score(awkward, model, words, keep=(F.col("text"),)).collect()
    assert len(got) == awkward.count()
    for r in got:
        own = (r.text or "").split()
        assert (r.n_tokens, r.n_known) == (len(own) + 1, len(own) + 1) and r.score <= 0 and (r.bits_per_byte is None) == (not r.text)
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 5}) == 1
    none, no_words = lm.train(awkward.limit(0))
    assert all(r.score <= 0 and r.n_known == 0 for r in lm.score(awkward, none, no_words).collect())


def test_near_duplicates(awkward):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert {r.component_id for r in got if r.doc_id == 5} == {5}
    similar = simhash.similar_documents(awkward).collect()
    assert len(similar) == awkward.count()
    assert Counter(r.first for r in similar if r.doc_id == 5) == {True: 3}
    assert [(r.component_id, r["first"]) for r in similar if r.doc_id in (1, 2, 3)].count((1, True)) == 1
    assert simhash.similar_documents(awkward.limit(0)).count() == 0


def test_repeats(awkward):
    got = suffixes.without_repeats(awkward, length=30, gram=8, keep=(F.col("source"),))
    found = got.collect()
    assert len(found) == awkward.count() and got.columns[:2] == ["doc_id", "source"]
    assert {(r.n_removed, r.kept_text, r.source) for r in found if r.doc_id == 5} == {(len(STORY.format("nine")), "", "s1")}
    assert all(r.n_bytes == r.n_removed == 0 for r in found if r.doc_id in (1, 2))


def test_mix(spark, awkward):
    mixed = mixing.mix(awkward)
    assert mixed.count() == awkward.count()
    took = Counter({(r.doc_id, r.source, r.size): r.t for r in mixed.groupBy("doc_id", "source", "size").agg(F.sum("times").alias("t")).collect() if r.t})
    made = mixing.repeated(awkward, mixed)
    assert made.columns == awkward.columns
    assert Counter((r.doc_id, r.source, r.z) for r in made.select("doc_id", "source", mixing.words_in("text").alias("z")).collect()) == took
    assert Counter(texts(made)) == Counter(texts(mixing.repeated(awkward.repartition(5), mixing.mix(awkward.repartition(3)))))
    assert mixing.repeated(awkward.limit(0), mixing.mix(awkward.limit(0))).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_anything(spark, awkward, name, stage):
    plain = list(corpus_pipeline.COLUMNS)
    out = stage(spark, awkward, "")
    empty = stage(spark, awkward.limit(0), "")
    assert empty.count() == 0 and empty.columns == out.columns
    if name != "tokens":
        assert out.columns == plain and out.select(*plain).dtypes == awkward.select(*plain).dtypes
    before, after = texts(awkward), texts(out) if "text" in out.columns else None
    if name == "language":
        assert after == Counter({k: n for k, n in before.items() if any(c.isalpha() for c in k[1] or "")})
    if name == "near_duplicates":  # nulls and blanks are one group, as are the seven boats' and the nine boats' story
        groups = {k: 1 for k in before if (k[1] or "").strip() and not (k[0] is None and "harbour" in k[1])}
        assert sum(after[k] for k in after if not (k[1] or "").strip()) == 1
        assert {k: n for k, n in after.items() if (k[1] or "").strip() and "harbour" not in k[1]} == {k: n for k, n in groups.items() if "harbour" not in k[1]}
        assert after[5, STORY.format("nine")] == 1
    if name == "repeated_passages":
        assert sum(after.values()) == sum(before.values()) and after[None, None] == 1 and after[1, None] == 1
    if name == "tokens":
        assert out.count() == awkward.count() and {r.n_tokens for r in out.where("doc_id in (1, 2)").collect()} == {0}


def test_splits_hash_the_id_as_text(spark):
    from millrace.llm.common import remainder

    got = spark.range(50).select("id", remainder("id", 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)


@pytest.mark.parametrize("words", [51, 58, 65])
def test_stage_cuts_passages_of_over_50_words(spark, words):
    passage = " ".join(("on", "the", "day", "sea", "we", "saw", "old", "men")[i * i % 8] + "abcdefgh"[i % 8] for i in range(words))
    assert 200 <= len(passage) < 400
    own = lambda n: " ".join(f"w{n}x{i * 37 % 101}" for i in range(60))
    rows = [(n, f"{own(2 * n)} {passage} {own(2 * n + 1)}" if n < 2 else own(9), "en", "s0", 1) for n in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert all(passage[:40] not in out[n] and 0 <= len(rows[n][1]) - len(passage) - len(out[n]) < 20 for n in (0, 1)) and out[2] == rows[2][1]


def test_tokens_are_decoded(spark, awkward):
    out = corpus_pipeline.tokens(spark, awkward, "")
    assert out.count() == bpe.decode(out, WORD_BPE, text="again").where("decoded = again").count() == awkward.count()
    assert {r.decoded == "" for r in out.where("doc_id in (1, 2)").collect()} == {True} and "harbour" in out.where("doc_id = 5").first().decoded
