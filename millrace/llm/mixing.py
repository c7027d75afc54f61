"""Mixing sources to target weights with the cube method.

A target fixes for each source how many words to take, as a share r of what it has; a document
is taken floor(r) times for certain and once more with probability r - floor(r). The cube method
makes those choices so that each source's number of documents and number of words both stay
where the probabilities put them: a unit with fractional probability moves with two others along the null
space of the two balances until one of the three is 0 or 1. Blocks of bounded size run side by
side, each leaves at most two units open, and those are gathered into new blocks until one
small landing problem per source remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unused, written

EPS = 1e-9


def flight(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1 with sum(p) and sum(p * sizes) kept; at most two stay in between."""
    out = p.tolist()
    size = sizes.tolist()
    open_: list[int] = []
    at, n, used = 0, len(out), 0
    while True:
        while len(open_) < 3 and at < n:
            if EPS < out[at] < 1 - EPS:
                open_.append(at)
            at += 1
        if len(open_) < 3:
            # Two units of one size can still be moved against each other without any change of the sums.
            if len(open_) < 2 or size[open_[0]] != size[open_[1]]:
                break
            move = [(open_[0], 1.0), (open_[1], -1.0)]
        else:
            a, b, c = open_
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            top = max(map(abs, u))
            move = [(i, x / top) for i, x in zip(open_, u) if x]
        up = min((1 - out[i]) / x if x > 0 else out[i] / -x for i, x in move)
        down = min(out[i] / x if x > 0 else (1 - out[i]) / -x for i, x in move)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for i, x in move:
            v = out[i] + step * x
            out[i] = 0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v
        open_ = [i for i in open_ if 0.0 < out[i] < 1.0]
    return np.array([0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v for v in out])


def reserve(sizes: np.ndarray, most: int = 12) -> np.ndarray:
    """Units, from the shortest to the longest, that are kept out of the flight for the landing: their sums can make up for whatever stays open."""
    order = np.argsort(sizes, kind="stable")
    return np.unique(order[np.linspace(0, len(order) - 1, min(most, len(order))).astype(int)]) if len(order) else order


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last few open units set to 0 or 1: the choice whose words come nearest to the expected ones, then the likeliest."""
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    choices = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    off = np.abs(choices @ sizes[left] - (p[left] * sizes[left]).sum())
    odds = np.abs(choices - p[left]).sum(axis=1)
    out = p.copy()
    out[left] = choices[np.lexsort((odds, off))[0]]
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row per source.

    Sources by code point, null last, have the weights in turn and share ``total`` times all
    sizes; no target exceeds ``most`` times its source's size, and what is over goes to the others
    by weight. With all capped (``total`` >= ``most``) each gets its cap. Only this table of one row
    per source is ordered as a whole.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("n", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") + 1).cast("int")))
    # In the order of cap / weight a source is capped if the level that all later ones would share reaches its own.
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        weighed.withColumn("capped_before", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("pool", F.lit(total) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("pool") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("over", F.col("level") * F.col("weight") > F.lit(most) * F.col("source_size"))
    )
    level = F.max(F.when(~F.col("over"), F.col("level"))).over(every)
    return ranked.withColumn("share", level).select("source", "source_size", F.when(F.col("over") | F.col("share").isNull(), F.lit(most) * F.col("source_size")).otherwise(F.col("share") * F.col("weight")).cast("double").alias("target"))


def _solve(units: DataFrame, seed: int, block_rows: int) -> DataFrame:
    """(key, take) of units (key, source_key, size, p) with 0 < p < 1, take 0 or 1."""
    spark = units.sparkSession

    def fly(last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            names, sizes, p = table["key"].to_numpy(), table["size"].to_numpy().astype(np.float64), table["p"].to_numpy()
            order = np.lexsort((names, -sizes))  # the longest first, so that what stays open is short
            draws = np.random.default_rng([seed, *(int(k.as_py()) & 0xFFFFFFFF for k in key)]).random(max(1, len(p)))
            moved = p.copy()
            if last:
                order = order[~np.isin(order, reserve(sizes))]
            moved[order] = flight(p[order], sizes[order], draws)
            if last:
                moved = landing(moved, sizes)
            return pa.table({"source_key": table["source_key"], "key": table["key"], "size": table["size"], "p": pa.array(moved)})

        return run

    schema = "source_key long, key long, size long, p double"
    done: DataFrame | None = None
    level = 0
    open_ = units
    while True:
        counts = open_.groupBy("source_key").count()
        top = counts.agg(F.max("count")).first()[0] or 0
        last = top <= block_rows
        # A block holds about block_rows units of one source, wherever its hash puts them; sources differ in how many they need.
        placed = open_.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "source_key").select(
            "source_key", "key", "size", "p", F.pmod(F.xxhash64("key", F.lit(seed + level)), F.ceil(F.col("count") / block_rows)).alias("block")
        )
        moved = written(placed.groupBy("source_key", "block").applyInArrow(fly(last), schema), f"flight{level}")
        if last:
            settled = moved
        else:
            settled, open_ = moved.where("p in (0, 1)"), moved.where("p not in (0, 1)")
        settled = settled.select("key", F.col("p").cast("long").alias("take"))
        done = settled if done is None else done.unionByName(settled)
        level += 1
        if last:
            return done


def words_in(text: str) -> Column:
    """The number of words of a text, 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    total: float = 1.5,
    most: float = 2.0,
    seed: int = 5,
    block_rows: int = 4_096,
) -> DataFrame:
    """id_col, source, size, source_size, target and ``times`` of every row: how often the mix takes it.

    ``size`` is the number of words (null text: 0). Targets as in ``targets``; ``times`` is floor(r)
    or one more for r = target / source_size (0 for a source without words), so no row exceeds
    ceil(``most``) times. Rows are units by their own hash, so repeated ids and rows are chosen apart; null ids count
    as rows like any other. The same rows give the same mix.
    """
    sized = df.select(F.col(id_col), F.col(source).alias("source"), words_in(text).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("_text"))
    sized = written(sized, "sizes")
    # Equal rows get different numbers; which of them is which makes no difference. Rows that only lack an id are told apart by their texts.
    twins = Window.partitionBy(id_col, "source", "size", "_text").orderBy(F.lit(0))
    numbered = sized.withColumn("_twin", F.row_number().over(twins))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most)
    by_source = written(by_source.withColumn("source_key", F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))), "targets")
    few = F.broadcast(by_source) if by_source.count() <= 10_000 else by_source
    units = numbered.join(few.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = units.withColumn("_r", ratio).withColumn("_whole", F.floor(F.col("_r") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("_r") - F.col("_whole"))).withColumn("key", F.xxhash64(F.lit(seed), F.col(id_col), "source", "size", "_text", "_twin"))
    fractional = units.where(F.col("p") > EPS).select("source_key", "key", "size", "p")
    chosen = _solve(fractional, seed, block_rows)
    return (
        units.join(chosen, "key", "left")
        .withColumn("times", (F.col("_whole") + F.coalesce("take", F.lit(0))).cast("long"))
        .select(id_col, "source", "size", "source_size", "target", "times")
    )


def repeated(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df's rows as often as ``mixed``, a mix of the same rows, says; rows that it takes no time are left out.

    Rows of one id (or none) that the mix takes equally often are matched by that id. Where it does not, they
    are matched by source and size too, and rows equal in all three get its different counts in the order of their texts' hash.
    """
    own, size, n = (unused(df, x) for x in ("mixed_id", "mixed_size", "mixed_twin"))
    times = unused(df, "mixed_times")
    by_id = mixed.groupBy(F.col(id_col).alias(own)).agg(F.min("times").alias("least"), F.max("times").alias(times))
    even = by_id.where(F.col("least") == F.col(times)).where(F.col(times) > 0).select(own, times)
    copies = lambda found: found.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[f"`{c}`" for c in df.columns])
    out = copies(df.join(even, F.col(id_col).eqNullSafe(F.col(own))))
    uneven = written(by_id.where(F.col("least") < F.col(times)).select(own), "uneven")
    if uneven.isEmpty():
        return out
    twins = lambda order, *by: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    counted = mixed.join(uneven, F.col(id_col).eqNullSafe(F.col(own)), "left_semi").withColumn("n", twins(F.desc("times"), id_col, "source", "size"))
    counted = counted.select(F.col(id_col).alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "n", F.col("times").alias(times)).where(F.col(times) > 0)
    rows = df.join(uneven, F.col(id_col).eqNullSafe(F.col(own)), "left_semi").withColumn(size, words_in(text))
    rows = rows.withColumn(n, twins(F.xxhash64(text), id_col, source, size)).alias("rows")
    counted = counted.alias("counted")
    same = F.col(f"rows.{id_col}").eqNullSafe(F.col("counted.i")) & F.col(f"rows.{source}").eqNullSafe(F.col("counted.s")) & (F.col(f"rows.{size}") == F.col("counted.z")) & (F.col(f"rows.{n}") == F.col("counted.n"))
    more = rows.join(counted, same).select(*[F.col(f"rows.`{c}`") for c in df.columns], F.col(f"counted.{times}"))
    return out.unionByName(copies(more))
