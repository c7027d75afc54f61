"""The quality filter with its labels and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import score_samples
from .dedup import _scope, first_wins, numbered

STATUSES = ("passed", "failed_length", "failed_quality", "failed_duplicate")


@dataclass(frozen=True)
class FilterConfig:
    """The defaults of the filter."""

    min_overall_score: float = 0.6
    min_word_count: int = 10
    max_word_count: int = 500
    enable_deduplication: bool = True
    similarity_threshold: float = 0.85


def length_filter(df: DataFrame, low: int = 10, high: int = 500) -> DataFrame:
    """Rows of ``low`` to ``high`` words."""
    return df.where(T.word_count(F.col("text")).between(low, high))


def quality_filter(df: DataFrame, config: FilterConfig = FilterConfig(), coherence: DataFrame | None = None, scope: list[str] = []) -> DataFrame:
    """Every row with its scores, ``status`` and ``reason``: length first, then duplicates of kept rows, then the overall score."""
    scored = score_samples(df, coherence)
    if config.enable_deduplication and not {"_hash", "_set"} <= set(scored.columns):
        scored = scored.withColumns({"_hash": T.text_hash(F.col("text")), "_set": T.hashed_set(F.col("text"))})
    scored = numbered(scored, "_row")
    fits = F.col("word_count").between(config.min_word_count, config.max_word_count)
    good = F.col("overall_score") >= config.min_overall_score
    if config.enable_deduplication:
        rows = scored.where(fits).select(F.col("_row").alias("row"), "seq", _scope(scope).alias("scope"), F.col("_hash").alias("hash"), F.col("_set").alias("words"), good.alias("eligible"))
        reasons = first_wins(rows, config.similarity_threshold).select(F.col("row").alias("_row"), "reason")
        scored = scored.select(*[c for c in scored.columns if c in df.columns or c not in ("_hash", "_set")]).join(reasons, "_row", "left")
    else:
        scored = scored.withColumn("reason", F.lit(None).cast("string"))
    status = F.when(~fits, "failed_length").when(F.col("reason").isNotNull(), "failed_duplicate").when(~good, "failed_quality").otherwise("passed")
    return scored.withColumn("status", status).drop("_row")


def filter_stats(labelled: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts and rates of each status; the rates of no rows are null."""
    count = lambda s: F.count_if(F.col("status") == s)
    names = {"passed": "pass_rate", "failed_length": "length_failure_rate", "failed_quality": "quality_failure_rate", "failed_duplicate": "duplicate_rate"}
    return labelled.groupBy(*by).agg(F.count("*").alias("total_processed"), *[count(s).alias(s) for s in STATUSES], *[F.try_divide(count(s), F.count("*")).alias(n) for s, n in names.items()])


def batch_summary(labelled: DataFrame, job: list[str], most_listed: int = 10) -> DataFrame:
    """For each job: rows in and kept, mean score and tokens of the kept, and their scores if there are at most ten."""
    passed = F.col("status") == "passed"
    totals = labelled.groupBy(*job).agg(
        F.count("*").alias("original_count"),
        F.count_if(passed).alias("filtered_count"),
        F.avg(F.when(passed, F.col("overall_score"))).alias("avg_overall"),
        F.coalesce(F.sum(F.when(passed, F.col("tokens_estimated"))), F.lit(0)).alias("tokens"),
    )
    # Lists are made for jobs that keep at most ten rows, and for no others.
    few = totals.where(F.col("filtered_count") <= most_listed).select(*job)
    lists = labelled.where(passed).join(few, job, "left_semi").groupBy(*job).agg(F.array_sort(F.collect_list(F.struct("seq", F.round("overall_score", 6).alias("overall_score")))).alias("metrics"))
    return totals.join(lists, job, "left").withColumn("metrics", F.coalesce("metrics", F.array().cast("array<struct<seq: bigint, overall_score: double>>")))
