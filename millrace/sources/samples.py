"""Sample tables in and out, and jobs' nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = "seq long, id string, job_id string, product string, template_type string, prompt_version string, generated_at timestamp, text string, tokens_estimated int, temperature double"
RESULT = f"samples array<struct<{SAMPLE}>>, total_samples int, total_tokens_estimated int"


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A sample table from JSON lines or Parquet; fields that are missing are null, others are left out."""
    return spark.read.schema(SAMPLE).format(fmt).load(path)


#: Fields that a sample can't be without.
NEEDED = ("id", "product", "prompt_version", "generated_at", "text", "tokens_estimated", "temperature")


def checked_samples(spark: SparkSession, path: str, fmt: str = "json", needed: tuple[str, ...] = NEEDED) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected rows with ``raw`` and ``reasons``) from JSON lines or Parquet.

    A row is rejected if it can't be read, lacks a ``needed`` field or has fewer than no tokens. ``raw`` is the line as it stands, or a
    Parquet row as JSON. Both tables come from one scan each and are no copy of the file.
    """
    if fmt == "json":
        lines = spark.read.text(path)
        parsed = lines.withColumn("_s", F.from_json("value", f"{SAMPLE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        fields = [f.split()[0] for f in SAMPLE.split(", ")]
        # Columns that the folders' names hold are in no line.
        found = [F.coalesce(F.col(f"_s.{f}"), F.col(f).cast("string")).alias(f) if f in lines.columns else F.col(f"_s.{f}").alias(f) for f in fields]
        rows = parsed.where("trim(value) <> ''").select(*found, F.col("value").alias("raw"), F.col("_s._bad").isNotNull().alias("_bad"))
    else:
        rows = read_samples(spark, path, fmt)
        rows = rows.select("*", F.to_json(F.struct(*rows.columns)).alias("raw"), F.lit(False).alias("_bad"))
    lacks = [F.when(~F.col("_bad") & F.col(c).isNull(), f"missing {c}") for c in needed]
    reasons = F.array_compact(F.array(F.when(F.col("_bad"), "not readable"), *lacks, F.when(F.col("tokens_estimated") < 0, "tokens_estimated below 0")))
    rows = rows.withColumn("reasons", reasons)
    return rows.where("size(reasons) = 0").drop("raw", "_bad", "reasons"), rows.where("size(reasons) > 0").select("raw", "reasons")


def write_samples(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """The table by prompt version: versions are few, products are not."""
    df.write.partitionBy("prompt_version").mode(mode).format(fmt).save(path)


def flatten_results(jobs: DataFrame, payload: str = "result") -> DataFrame:
    """A row for each sample in the JSON ``payload`` of each job; a job without samples keeps one row."""
    parsed = jobs.withColumn("_r", F.from_json(payload, RESULT))
    return parsed.withColumn("_s", F.explode_outer("_r.samples")).drop(payload, "_r").select(*[c for c in jobs.columns if c != payload], F.col("_s.id").alias("sample_id"), F.col("_s.text").alias("text"), F.col("_s.tokens_estimated").alias("tokens_estimated"))


def assemble_results(samples: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """For each job its samples in order, their number and their tokens. An array is as long as its job."""
    item = F.struct(F.col(order), *[c for c in ("id", "text", "tokens_estimated") if c in samples.columns])
    return samples.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("samples"), F.count("*").alias("total_samples"), F.sum("tokens_estimated").alias("total_tokens_estimated"))


def assemble_parts(samples: DataFrame, keys: list[str], order: str = "seq", rows: int = 1_000, size: int = 8 << 20) -> DataFrame:
    """``assemble_results`` in numbered rows (``part``, from 0) of at most ``rows`` samples and ``size`` bytes of text, a larger text alone in one, with the totals of the whole job.

    Parts in the order of their numbers give the job's samples in theirs. A sample's part follows from the rows and bytes before it in its job, which are counted
    by ranges of (job, order): no task holds a job.
    """
    from ..operators.stretches import positions

    measured = samples.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("_big", (F.col("_bytes") > size // 2).cast("long"))
    placed, ends = positions(measured, keys, [order], ("_bytes", "_big"))
    before = lambda c: F.col(f"_before_{c}") + F.col(f"_sum_{c}")
    # Half the size for what is before a sample, so that the last one fits; a big text has a place of its own.
    place = F.floor((F.col("_rows_before") + F.col("_n")) / rows) + F.floor(before("_bytes") / (size // 2)) + 2 * before("_big") + F.col("_big")
    dealt = placed.join(ends.select("_key", "_part", "_rows_before", "_before__bytes", "_before__big"), ["_key", "_part"]).withColumn("_place", place)
    item = F.struct(F.col(order), *[c for c in ("id", "text", "tokens_estimated") if c in samples.columns])
    made = dealt.groupBy("_key", "_place").agg(*[F.first(c).alias(c) for c in keys], F.array_sort(F.collect_list(item)).alias("samples"), F.count("*").alias("_n"), F.sum("tokens_estimated").alias("_t"))
    heads = dealt.groupBy("_key", "_place").agg(F.count("*").alias("_n"), F.sum("tokens_estimated").alias("_t"))
    numbers = heads.select("_key", "_place", (F.row_number().over(Window.partitionBy("_key").orderBy("_place")) - 1).cast("int").alias("part"))
    totals = heads.groupBy("_key").agg(F.sum("_n").alias("total_samples"), F.sum("_t").alias("total_tokens_estimated"))
    return made.join(numbers, ["_key", "_place"]).join(totals, "_key").select(*keys, "part", "samples", "total_samples", "total_tokens_estimated")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores where its files give fewer: a file of one row group is a single task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
