"""Ordered rules over a log that is cut by ranges of (key, order), so that a hot key lies in many tasks.

A task walks its stretch of each key in order and, at its end, leaves a row that says how what comes before
the stretch changes what comes after it. Only those rows are chained, key by key. No key has more of them than there are tasks (and
blocks, where a stretch is cut further).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranged(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """log in ranges of (keys, order), each sorted."""
    return log.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)


def described(log: DataFrame, more: str) -> str:
    """The schema of log's columns and ``more``."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields] + [more])


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch | None, bool]]:
    """(rows of one key, whether the key is new) in order."""
    current, started = None, False
    for batch in batches:
        keys = batch.column(key)
        codes = pc.fill_null(keys.dictionary_encode().indices, -1)
        ends = pc.indices_nonzero(pc.not_equal(codes.slice(1), codes.slice(0, max(0, len(codes) - 1)))).to_pylist()
        bounds = [0, *(e + 1 for e in ends), len(codes)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                own = keys[a].as_py()
                yield batch.slice(a, b - a), not started or own != current
                current, started = own, True


def extended(batch: pa.RecordBatch, schema: pa.Schema, more: list[pa.Array]) -> pa.RecordBatch:
    """batch with the columns ``more`` after its own; columns of ``schema`` that are still missing are null."""
    arrays = [*batch.columns, *more]
    arrays += [pa.nulls(batch.num_rows, f.type) for f in list(schema)[len(arrays) :]]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def end_row(last: pa.RecordBatch, key: str, schema: pa.Schema, values: dict) -> pa.RecordBatch:
    """A row of ``last``'s key with ``values`` and nulls elsewhere."""
    arrays = []
    for f in schema:
        if f.name == key:
            arrays.append(last.column(key).slice(last.num_rows - 1, 1))
        else:
            arrays.append(pa.array([values.get(f.name)], f.type))
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def several(ends: DataFrame, key: str) -> DataFrame:
    """The rows of ``ends`` whose key has more than one."""
    many = ends.groupBy(F.col(key).alias("_many")).count().where("count > 1").select("_many")
    return ends.join(many, F.col(key).eqNullSafe(F.col("_many")), "left_semi")


def same(pairs: dict[str, str]) -> Column:
    """Equal columns, nulls alike."""
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def positions(df: DataFrame, keys: list[str], order: list[str], sums: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(df with _part, _n and, for each long column in ``sums``, its sum over the rows before: all within the stretch; the stretches).

    Null keys are keys. A stretch has keys and _part, its rows and sums, as _rows and _all_..., and those of the key's earlier stretches, as _rows_before and
    _before_...; there are as many as keys and tasks together. Rows of equal ``order`` come in any order, but in the same one whenever the result is read.
    """
    names = df.columns
    named = df.withColumn("_key", F.struct(*keys, F.lit(0)).cast("string"))
    schema = described(named, ", ".join(["_part int", "_n long", *[f"_sum_{s} long" for s in sums]]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for rows, new in runs(batches, "_key"):
            if new:
                n, total = 0, [0] * len(sums)
            made = [np.full(rows.num_rows, part, np.int32), n + np.arange(rows.num_rows)]
            n += rows.num_rows
            for i, s in enumerate(sums):
                own = rows.column(s).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                made.append(total[i] + np.cumsum(own) - own)
                total[i] += int(own.sum())
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, made)], [*rows.schema.names, "_part", "_n", *[f"_sum_{s}" for s in sums]])

    walked = written(ranged(named, keys, order).mapInArrow(walk, schema), "positions")
    ends = walked.groupBy("_key", "_part").agg(F.count("*").alias("_rows"), *[F.coalesce(F.sum(s), F.lit(0)).alias(f"_all_{s}") for s in sums])
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ends = ends.select("*", zero("_rows").alias("_rows_before"), *[zero(f"_all_{s}").alias(f"_before_{s}") for s in sums])
    return walked.select(*names, "_key", "_part", "_n", *[f"_sum_{s}" for s in sums]), written(ends, "ends")
