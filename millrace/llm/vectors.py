"""Blocked search: every query against every shard of rows.

Rows go to shards by a hash of their id. A shard's rows come first in its task, which builds one index of
them; then queries stream past it in batches. A task holds about ``shard_rows`` vectors and one batch of
queries, whatever the size of the table or of a group of equal vectors. It returns its nearest rows
for each query, and a window over (query) merges them: shards x queries x k rows. Only where there are more than
``block_rows`` queries is a shard sent and its index built again, so that tasks stay short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, wide


def usable(df: DataFrame, vector: str, zero: bool) -> DataFrame:
    """Rows whose vector is not null or empty and has only finite components; an all-zero one only if zero is true."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine if zero else fine & F.exists(v, lambda x: x != 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal rows get equal scores to the last bit."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * query[d]
    return out


def grouped(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, and the ids ordered by (vector, id) with each vector's first place: copies are searched once."""
    distinct, member = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, member.ravel()))
    ids, member = ids[order], member.ravel()[order]
    first = np.append(True, (ids[1:] != ids[:-1]) | (member[1:] != member[:-1]))  # a repeated row once
    return distinct, ids[first], np.searchsorted(member[first], np.arange(len(distinct) + 1))


def pick(found: np.ndarray, scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids among distinct vectors' members, ties to the smaller id, without the query's own id."""
    out_ids, out_scores = [], []
    for g, s in zip(found, scores):
        mine = ids[starts[g] : min(starts[g + 1], starts[g] + k + 1)]
        mine = mine[mine != own]
        out_ids.append(mine)
        out_scores.append(np.full(len(mine), s))
    if not out_ids:
        return np.empty(0, np.int64), np.empty(0)
    all_ids, all_scores = np.concatenate(out_ids), np.concatenate(out_scores)
    best = np.lexsort((all_ids, -all_scores))[:k]
    return all_ids[best], all_scores[best]


def blocked_top_k(
    df: DataFrame,
    id_col: str,
    vector: str,
    is_query: Column,
    k: int,
    index: Callable[[np.ndarray], Callable],
    score_type: str,
    shard_rows: int,
    block_rows: int,
    batch: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query.

    df's vectors are usable arrays. ``index(distinct vectors)`` returns a function from queries and the count wanted to
    (numbers of distinct vectors, scores) of each query. There are at least 64 shards, or one for every
    4,096 rows if that is fewer.
    Vectors of another length than most rows have (ties: the longer) take no part. Rows without an id take no
    part. A repeated id counts once, with its best score.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q")).where("vec_id is not null")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    schema = f"query_id long, vec_id long, score {score_type}"
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    dim, n, nq = sizes[0]
    shards, groups = max(blocks(n, shard_rows), min(blocks(n, 4_096), 64)), blocks(nq, block_rows)
    rows = rows.where(F.size("v") == dim)
    place = lambda many, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    stored = rows.select(place(shards, 1).alias("shard"), every(groups).alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = rows.where("q").select(every(shards).alias("shard"), place(groups, 2).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    kind = np.int64 if score_type == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, search, ids, starts = None, [], None, None, None
        for whole in batches:
            labels = [whole.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in labels], axis=0)) + 1
            for a, b in zip(np.append(0, change), np.append(change, whole.num_rows)):
                if (labels[0][a], labels[1][a]) != group:
                    group, held, search = (labels[0][a], labels[1][a]), [], None
                names, values = whole.column(3).slice(a, b - a).to_numpy(), matrix(whole.column(4).slice(a, b - a))
                if not labels[2][a]:
                    held.append((names, values))
                    continue
                if search is None and held:
                    distinct, ids, starts = grouped(*map(np.concatenate, zip(*held)))
                    held, search = [], index(distinct)
                out = ([], [], [])
                for at in range(0, len(names) if search else 0, batch):
                    # One more than k distinct vectors: one may hold nothing but the query itself.
                    for own, (found, scores) in zip(names[at : at + batch], search(values[at : at + batch], k + 1)):
                        mine, best = pick(found, scores, ids, starts, own, k)
                        out[0].append(np.full(len(mine), own, np.int64))
                        out[1].append(mine)
                        out[2].append(best)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, (np.int64, np.int64, kind))], ["query_id", "vec_id", "score"])

    dealt = stored.unionByName(asked).repartition(wide(spark, shards * groups), "shard", "block").sortWithinPartitions("shard", "block", "asks")
    near = dealt.mapInArrow(run, schema)
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
