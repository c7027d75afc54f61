"""Hard negatives by slots between positives' scores.

An anchor's positives are its best rows of its own label. The window of a positive reaches from its own score, the upper
limit, down to a share of it, so an anchor's windows overlap. Their upper limits cut the scores into disjoint
slots: slot i holds what scores at most as much as positive i and more than positive i + 1. A search keeps the best
``k`` rows of each slot only; then, from the last slot up, each slot's rows are put before what the slots after it
left, and the first ``k`` of that are the best of all rows under the upper limit of its positive. What lies below the
window's lower limit comes last in it and is cut off. So rows are scored once, whatever the number of windows.

Both searches (positives, then negatives) run over a grid: rows in shards, anchors in blocks, by hashes of their
ids, so no label or group of equal vectors gathers in a task. A task holds one shard and a batch of anchors,
multiplies them tile by tile and returns the best of each slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, wide, written
from .vectors import matrix, usable

#: Rows of a shard that are multiplied with a batch of anchors at a time.
TILE = 8_192
BATCH = 128


def first_of(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, group))
    ordered = group[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < k]


class Shard:
    """The rows of a shard; of equal vectors with one label, only the ``spare`` smallest ids can be among the best."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, spare: int):
        # A repeated id counts once, with its smallest (label, vector).
        order = np.lexsort((*rows.T[::-1], labels, ids))
        ids, labels, rows = ids[order], labels[order], rows[order]
        once = np.append(True, ids[1:] != ids[:-1])
        ids, labels, rows = ids[once], labels[once], rows[once]
        _, kind = np.unique(np.column_stack([labels, rows]), axis=0, return_inverse=True)
        keep = first_of(kind.ravel(), np.zeros(len(ids)), ids, spare)
        keep = keep[np.argsort(labels[keep], kind="stable")]
        self.ids, self.labels, self.rows = ids[keep], labels[keep], rows[keep]

    def best(self, own: np.ndarray, label: np.ndarray, asked: np.ndarray, limits: np.ndarray | None, low: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's number, slot, row, score) of the best: with ``limits`` (positives' scores, falling, -inf where there is none) rows of other labels by slots, without them rows of the same label."""
        held = [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        slots = 1 if limits is None else limits.shape[1]
        # Nothing below the share of the last positive's score lies in a window; a negative score has none.
        floor = np.full(len(own), -np.inf) if limits is None else np.where(limits >= 0, limits, np.inf).min(axis=1) * low
        for at in range(0, len(self.ids), TILE):
            part = slice(at, at + TILE)
            if limits is None and not np.isin(label, self.labels[part]).any():
                continue
            scores = asked @ self.rows[part].T
            same = label[:, None] == self.labels[part]
            if limits is None:
                fits = same & (own[:, None] != self.ids[part]) & (scores >= floor[:, None])
                if fits.shape[1] > k:  # only what is among the tile's best can be among the shard's
                    least = -np.partition(np.where(fits, -scores, np.inf), k - 1, axis=1)[:, k - 1]
                    fits &= scores >= least[:, None]
            else:
                fits = ~same & (scores <= limits[:, :1]) & (scores >= floor[:, None])
            a, r = np.nonzero(fits)
            s = scores[a, r]
            slot = np.zeros(len(a), np.int64) if limits is None else (s[:, None] <= limits[a]).sum(axis=1) - 1
            found = [np.concatenate(x) for x in zip(held, (a, slot, r + at, s))]
            keep = first_of(found[0] * slots + found[1], found[3], self.ids[found[2]], k)
            held = [x[keep] for x in found]
            if limits is None:
                full = np.flatnonzero(np.bincount(held[0], minlength=len(own)) == k)
                worst = np.full(len(own), np.inf)
                np.minimum.at(worst, held[0], held[3])
                floor[full] = worst[full]
        return tuple(held)


def _grid(rows: DataFrame, anchors: DataFrame, dim: int, slots: int, low: float, k: int, spare: int, shards: int, groups: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the k best rows of each anchor and slot in every shard.

    ``rows``: vec_id, label, v; ``anchors``: the same and ``limits``, null in the search of positives.
    """
    place = lambda many, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    stored = rows.select(place(shards, 1).alias("shard"), every(groups).alias("block"), F.lit(0).alias("asks"), "vec_id", "label", "v", F.lit(None).cast("array<double>").alias("limits"))
    asked = anchors.select(every(shards).alias("shard"), place(groups, 2).alias("block"), F.lit(1).alias("asks"), "vec_id", "label", "v", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, shard, before = None, [], None, None
        for whole in batches:
            marks = [whole.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in marks], axis=0)) + 1
            for a, b in zip(np.append(0, change), np.append(change, whole.num_rows)):
                if (marks[0][a], marks[1][a]) != group:
                    group, held, shard, before = (marks[0][a], marks[1][a]), [], None, None
                cut = whole.slice(a, b - a)
                ids, labels, values = cut.column(3).to_numpy(), cut.column(4).to_numpy(), matrix(cut.column(5))
                if not marks[2][a]:
                    held.append((ids, labels, values))
                    continue
                if shard is None and held:
                    shard, held = Shard(*map(np.concatenate, zip(*held)), spare), []
                if shard is None:
                    continue
                fresh = np.append(ids[0] != before, ids[1:] != ids[:-1])  # a repeated anchor once: its rows come in order
                before = ids[-1]
                ids, labels, values = ids[fresh], labels[fresh], values[fresh]
                limits = None
                if slots:
                    lists = cut.column(6).filter(pa.array(fresh))
                    limits = np.full((len(ids), slots), -np.inf)
                    sizes = np.diff(lists.offsets.to_numpy())
                    limits[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
                for at in range(0, len(ids), BATCH):
                    cut_ = slice(at, at + BATCH)
                    own, slot, row, score = shard.best(ids[cut_], labels[cut_], values[cut_], limits[cut_] if slots else None, low, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cut_][own]), pa.array(slot.astype(np.int32)), pa.array(shard.ids[row]), pa.array(score.astype(np.int64))], ["anchor_id", "slot", "vec_id", "score"])

    dealt = stored.unionByName(asked).repartition(wide(rows.sparkSession, shards * groups), "shard", "block").sortWithinPartitions("shard", "block", "asks", "vec_id", "label", "v")
    near = dealt.mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    k: int = 5,
    share: tuple[int, int] = (80, 100),
    shard_rows: int = 65_536,
    block_rows: int = 65_536,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to ``k`` hard negatives for each anchor and each of its ``positives``.

    Each component x becomes floor(scale * x); scores are integer inner products, exact below 2**53. Positives are the anchor's best
    other rows of its label, ties to the smaller id. A negative has another label and a score of at most its
    positive's and of at least share[0] / share[1] of it. A positive of negative score has an empty window.
    Rows without an id or a label, null and empty vectors, those with null or non-finite components and those of
    another length than most rows have (ties: the longer) take no part; zero vectors do. A repeated id counts once, with its
    smallest (label, vector). An empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    floored = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double"))
    rows = usable(df, vector, zero=True).select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), floored.alias("v"), is_anchor.alias("q"))
    rows = written(rows.where("vec_id is not null and label is not null"), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n, nq = sizes[0]
    rows = rows.where(F.size("v") == dim)
    shards, groups = max(blocks(n, shard_rows), min(blocks(n, 4_096), 64)), blocks(nq, block_rows)
    anchors = rows.where("q").withColumn("limits", F.lit(None).cast("array<double>"))
    best = _grid(rows, anchors, dim, 0, 0.0, positives, positives + 1, shards, groups)
    best = written(best.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"].cast("double")).alias("limits"))
    low, whole = share
    anchors = anchors.drop("limits").join(listed, F.col("vec_id") == F.col("anchor_id"))
    # A product of doubles may be a little too large: the exact limits are held below, this one lets through a little more.
    made = _grid(rows, anchors, dim, positives, low / whole * (1 - 1e-9), k, k, shards, groups)
    slots = made.groupBy("anchor_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("slot") == i, F.struct((-F.col("score")).alias("less"), F.col("vec_id"))))).alias(f"s{i}") for i in range(positives)])
    # From the last slot up: a slot's rows, and then those that the slots after it left.
    left, windows = F.array().cast("array<struct<less: bigint, vec_id: bigint>>"), []
    for i in reversed(range(positives)):
        left = F.slice(F.concat(F.col(f"s{i}"), left), 1, k)
        windows.append(F.struct(F.lit(i + 1).alias("place"), left.alias("found")))
    merged = slots.select("anchor_id", F.explode(F.array(*windows)).alias("w")).select("anchor_id", "w.place", F.posexplode("w.found").alias("at", "x"))
    near = merged.join(best, ["anchor_id", "place"]).where(F.lit(low) * F.col("positive_score") <= -F.col("x.less") * whole)
    return near.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score"))
