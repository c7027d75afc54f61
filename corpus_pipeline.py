"""A corpus pipeline over ``documents``: language, near-duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again for the next. All but the last return the columns of ``documents``; other columns of their input
are left out, whatever their names. Rows count as documents even if they have no id or share one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, mixing, simhash, suffixes
from millrace.llm.common import remainder, spread, written
from millrace.llm.entries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if no language holds at least this share of its likelihood.
LEAST_SHARE = 0.3
#: Bytes of a repeated passage: those of some 50 short words.
PASSAGE = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: texts that are null, have no letter or fit two languages alike go.

    The language column may be null; with no row that tells a language, nothing can be told and all go.
    """
    model = langid.train(docs.where(remainder("doc_id", 3) != 1))
    told = langid.identify(docs, model, pred="_pred", score="_score")
    return told.where((F.col("_pred") != langid.NONE) & (F.col("_score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 0.8 or more, the one of smallest doc_id (null last).

    A repeated row, too, stays once. Null, empty and blank texts are one group.
    """
    docs = docs.select(*COLUMNS)
    found = simhash.similar_documents(docs, words=5, similarity=0.8).where("first")
    kept = written(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "firsts").alias("kept")
    same = F.col("docs.doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.xxhash64("docs.text") == F.col("kept.text_hash"))
    held = lambda rows: docs.alias("docs").join(rows, same, "left_semi")
    out, twice = held(kept.where("n = 1")), kept.where("n > 1")
    return out if twice.isEmpty() else out.unionByName(held(twice).dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of PASSAGE bytes or more; a null text stays null, and n_chars is that of the text that is left."""
    cut = suffixes.without_repeats(docs, length=PASSAGE, keep=(F.col("lang"), F.col("source"), F.col("text").isNull().alias("none")))
    cut = cut.withColumn("text", F.when(~F.col("none"), F.col("kept_text")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; a null source is a source, and texts without words have no size."""
    docs = docs.select(*COLUMNS)
    return mixing.repeated(docs, mixing.mix(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text they decode to, none and an empty one for a null or empty text."""
    both = bpe.encode(docs.select("doc_id", "source", "text"), WORD_BPE, decoded="decoded")
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]

#: SQL has no SimHash, suffix array, cube method or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
