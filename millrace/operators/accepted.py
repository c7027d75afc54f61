"""What was accepted before, as an index in files: batches of texts are held against it and added to it.

A segment is what one batch added: the sets of hashed words of its texts, and lists of the sets under the words of their prefixes. Both
are partitioned by hash, so that a batch reads the partitions of its own words and of the sets that it meets there, and no
others. FAN segments are merged into one, FAN of those into a larger one and so on: before batch n there are as many
segments as n has digits' units in base FAN, and which they are depends on n alone. A batch that runs again
finds or writes the same segments. The order of words, which prefixes need, is set by the first batch and kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import dropped, scratch_path, swept, written
from .dedup import ORDERED, _listed, _set_key, held, may_be_near, may_reach, prefixes, ranked

FAN = 4


class AcceptedIndex:
    """The index under ``path``, for word sets of a Jaccard similarity of ``threshold``.

    ``buckets`` is the number of partitions of sets and of lists in a segment; with few rows in a batch and many accepted, a large number
    lets a batch read less.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.85, buckets: int = 16):
        self.spark, self.path, self.threshold, self.buckets = spark, path.rstrip("/"), threshold, buckets

    def _there(self, folder: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, folder: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), *columns), F.lit(self.buckets)).cast("int")

    def _put(self, df: DataFrame, name: str) -> None:
        with swept(self.spark):
            df.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}", compression="zstd")

    def segments(self, number: int) -> list[tuple[int, int]]:
        """The ranges of batches whose segments hold all batches before ``number``, large ones first."""
        out, begin, size = [], 0, 1
        while size * FAN <= number:
            size *= FAN
        while size:
            while begin + size <= number:
                out.append((begin, begin + size))
                begin += size
            size //= FAN
        return out

    def _read(self, name: str, number: int, schema: str) -> DataFrame:
        found = [f"{self.path}/{name}-{a}-{b}" for a, b in self.segments(number) if self._there(f"{self.path}/{name}-{a}-{b}")]
        rows = [self.spark.read.schema(f"{schema}, bucket int").parquet(f) for f in found]
        if not rows:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    SETS = "set long, set2 long, hash string, words array<bigint>"
    LISTS = "word long, set long, set2 long, n int, at int, p long, q long"

    def merge(self, number: int) -> None:
        """Write the larger segments that batch ``number`` reads and that are not there yet, and delete what they are made of."""
        for a, b in self.segments(number):
            size = b - a
            if size > 1:
                for k in range(a, b, size // FAN):
                    self.merge_range(k, k + size // FAN)
                self.merge_range(a, b)

    def merge_range(self, a: int, b: int) -> None:
        size = (b - a) // FAN
        for name, schema in (("sets", self.SETS), ("lists", self.LISTS)):
            whole, parts = f"{name}-{a}-{b}", [f"{name}-{k}-{k + size}" for k in range(a, b, max(1, size))] if size else []
            have = [p for p in parts if self._there(f"{self.path}/{p}")]
            if have and not self._there(f"{self.path}/{whole}"):
                rows = [self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{p}") for p in have]
                out = rows[0]
                for r in rows[1:]:
                    out = out.unionByName(r)
                self._put(out, whole)
            for p in parts:
                self._delete(f"{self.path}/{p}")

    def append(self, df: DataFrame, number: int = 0) -> None:
        """Add texts (``text``, or their ``_hash`` and ``_set``) as those of batch ``number``; what the batch added before goes."""
        rows = hashed(df).select("set", "set2", "hash", "words")
        rows = written(rows.groupBy("set", "set2", "hash").agg(F.first("words").alias("words")), "accepted")
        if not self._there(f"{self.path}/order"):
            counted = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
            counted.where("f > 1").orderBy(F.desc("f"), "word").limit(ORDERED).write.mode("overwrite").parquet(f"{self.path}/order")
        self._put(rows.withColumn("bucket", self._bucket("set", "set2")), f"sets-{number}-{number + 1}")
        lists = self._prefixes(rows.dropDuplicates(["set", "set2"]).select(F.struct("set", "set2").alias("cid"), "words"))
        lists = lists.select("word", "cid.set", "cid.set2", "n", "at", "p", "q")
        self._put(lists.withColumn("bucket", self._bucket("word")), f"lists-{number}-{number + 1}")
        dropped(rows)

    def _prefixes(self, sets: DataFrame) -> DataFrame:
        order = ranked(self.spark.read.schema("word long, f long").parquet(f"{self.path}/order").limit(ORDERED))
        return prefixes(sets.where("size(words) > 0").withColumn("scope", F.lit("")), self.threshold, order)

    def _only(self, table: DataFrame, buckets: DataFrame) -> DataFrame:
        """The partitions of ``table`` in ``buckets``: as literals, so that no other file is listed as input."""
        return table.where(F.col("bucket").isin([r[0] for r in buckets.distinct().collect()])).drop("bucket")

    def reasons(self, df: DataFrame, row: str, number: int = 1) -> DataFrame:
        """(``row``, reason) of df's rows that are equal or near to a text of a batch before ``number``; ``row`` is a number of each row's own."""
        self.merge(number)
        fresh = written(hashed(df).select(F.col(row).alias("row"), "set", "set2", "hash", "words"), "fresh")
        sets, lists = self._read("sets", number, self.SETS), self._read("lists", number, self.LISTS)
        own = fresh.withColumn("bucket", self._bucket("set", "set2"))
        known = self._only(sets, own.select("bucket")).select("set", "set2", F.col("hash").alias("old"))
        bare = fresh.select("row", "set", "set2", "hash", (F.size("words") > 0).alias("any"))
        same = bare.join(known, ["set", "set2"]).groupBy("row").agg(F.max(F.col("old") == F.col("hash")).alias("equal"), F.max("any").alias("near"))
        asks = written(self._prefixes(fresh.groupBy("set", "set2").agg(F.first("words").alias("words")).select(F.struct("set", "set2").alias("cid"), "words")), "prefixes") if self._there(f"{self.path}/order") else None
        if asks is None:
            return fresh.select("row", F.lit(None).cast("string").alias("reason")).limit(0)
        met = self._only(lists, asks.select(self._bucket("word").alias("bucket")))
        met = _listed(asks.drop("scope").withColumn("scope", F.lit("")), "a").join(_listed(met.select(F.struct("set", "set2").alias("cid"), "n", "at", "p", "q", "word", F.lit("").alias("scope")), "b").drop("scope"), "word")
        met = written(met.where(may_be_near(self.threshold)).select("a", "b").distinct(), "met")
        old = self._only(sets, met.select(self._bucket("b.set", "b.set2").alias("bucket")))
        old, own = (x.select(F.struct("set", "set2").alias("cid"), "words") for x in (old, fresh))
        listed, met = met, may_reach(met, own, old, self.threshold)
        dropped(asks, listed)

        def alike(pairs: DataFrame) -> DataFrame:
            pairs = written(pairs, "pairs")
            words = lambda x, side: held(x, pairs, side).groupBy(F.col("cid").alias(side)).agg(F.first("words").alias(f"w{side}"))
            both = pairs.join(words(own, "a"), "a").join(words(old, "b"), "b")
            shared = F.size(F.array_intersect("wa", "wb"))
            return written(both.where(shared / (F.size("wa") + F.size("wb") - shared) >= self.threshold).select("a").distinct(), "alike")

        # One near text is enough: first the likeliest of each, then all the others of those that it didn't settle.
        first = alike(met.groupBy("a").agg(F.min_by("b", "apart").alias("b")))
        near = first.unionByName(alike(met.join(first, "a", "left_anti").select("a", "b")))
        near = near.select("a.set", "a.set2").withColumn("_near", F.lit(True))
        found = fresh.select("row", "set", "set2").join(near, ["set", "set2"], "left").join(same, "row", "left")
        return found.select("row", F.when(F.col("equal"), "exact_duplicate").when(F.col("_near") | F.col("near"), "semantic_similarity").alias("reason")).where("reason is not null")


def hashed(df: DataFrame) -> DataFrame:
    """df's own _hash and _set columns, or those of its text (a null like an empty one), as hash, words, set and set2."""
    text = F.coalesce("text", F.lit("")) if "text" in df.columns else None
    both = (F.col("_set"), F.col("_hash")) if {"_hash", "_set"} <= set(df.columns) else (T.hashed_set(text), T.text_hash(text))
    return df.withColumns({"words": F.coalesce(both[0], F.array().cast("array<bigint>")), "hash": both[1]}).select("*", *_set_key())


def dedup_against(new: DataFrame, accepted: DataFrame | AcceptedIndex, threshold: float = 0.85, number: int = 1) -> DataFrame:
    """new with ``reason``: equal or near to a text of ``accepted``, else null. Columns _hash and _set spare the texts.

    ``accepted`` is a table, or an index of it, of which the batches before ``number`` count. An empty table and repeated rows are allowed.
    """
    spark = new.sparkSession
    if isinstance(accepted, DataFrame):
        index = AcceptedIndex(spark, scratch_path(spark, "index"), threshold)
        index.append(accepted)
        accepted, number = index, 1
    rows = written(new.withColumn("_row", F.monotonically_increasing_id()), "new")
    reasons = accepted.reasons(rows, "_row", number)
    return rows.join(reasons.withColumnRenamed("row", "_row"), "_row", "left").drop("_row")
