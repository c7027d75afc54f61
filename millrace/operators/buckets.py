"""Token buckets over a request log, in blocks of rows whose effect on a level is a function of the level before them.

A level rises with time up to its capacity, and a request that finds its cost there takes it. Where a pause is so long that the
bucket fills up, the level is the capacity whatever came before: a regeneration point. Between such points rows are walked side by side, one
of each stretch at a time. A block that has such a point leaves a level that is known. One without is chained by its gains and costs, two numbers a
row, in the same steps as a plain walk, as any other order of its sums would round differently and then let other requests pass. Where all
numbers are on a grid, so that sums are exact, the block maps the level before it to the level after it piece by piece: in each piece the
level after is the level before plus a constant, or a constant. Then every block is walked from its own level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.scratch import written
from .fold import fold, small_batches
from .stretches import described, end_row, extended, ranged, runs, same, several

MICROS = 1_000_000
#: Rows of a block, and pieces that its function may have; a block whose function has more is chained by its rows.
BLOCK = 4_096
PIECES = 16_384
#: Whole multiples of 1 / GRID have exact sums up to MOST.
GRID, MOST = float(1 << 20), float(1 << 32)
#: Stretches that are walked side by side; fewer are walked one by one.
ABREAST = 12


def amounts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers, with 0 for null and NaN."""
    return np.nan_to_num(column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf)


def levels(capacity: float, gains: np.ndarray, costs: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(admitted, level after) for each row: ``level`` is that before the first, ``gains`` what each row's pause adds, at most up to ``capacity``."""
    n = len(gains)
    begins = np.flatnonzero(np.append(True, gains[1:] >= capacity)) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    now = np.where(begins == 0, level, 0.0)  # after a regeneration point it doesn't matter
    passed, after = np.zeros(n, bool), np.zeros(n)
    step = 0
    live = len(begins)
    while live := int(np.searchsorted(-sizes[:live], -step, side="left")):
        if live < ABREAST:
            break
        at = begins[:live] + step
        mine = np.minimum(capacity, now[:live] + gains[at])
        fits = mine >= costs[at]
        passed[at], after[at] = fits, mine - np.where(fits, costs[at], 0.0)
        now = after[at]
        step += 1
    for i in range(live):
        a, b, mine = int(begins[i]) + step, int(begins[i] + sizes[i]), float(now[i])
        out, fits = [], []
        for gain, cost in zip(gains[a:b].tolist(), costs[a:b].tolist()):
            mine = min(capacity, mine + gain)
            fits.append(mine >= cost)
            if fits[-1]:
                mine -= cost
            out.append(mine)
        passed[a:b], after[a:b] = fits, out
    return passed, after


def on_grid(*numbers: np.ndarray | float) -> bool:
    """Whether sums and differences of all these, and of a level among them, are exact."""
    return all(bool(np.all(np.rint(x * GRID) == x * GRID)) for x in numbers) and float(sum(np.sum(np.abs(x)) for x in numbers)) < MOST


class Pieces:
    """A level after some rows as a function of the level before them: from ``low`` on, it is ``value`` plus, where ``moves``, the level before."""

    def __init__(self, low: np.ndarray, moves: np.ndarray, value: np.ndarray):
        self.low, self.moves, self.value = low, moves, value

    @classmethod
    def same(cls) -> Pieces:
        return cls(np.zeros(1), np.ones(1, bool), np.zeros(1))

    def cut(self, at: np.ndarray) -> None:
        """Split moving pieces where the level before reaches ``at`` (one for each piece), if that lies inside."""
        inside = self.moves & (at > self.low) & (at < np.append(self.low[1:], np.inf))
        if inside.any():
            spot = np.flatnonzero(inside) + 1
            self.moves, self.value = np.insert(self.moves, spot, self.moves[inside]), np.insert(self.value, spot, self.value[inside])
            self.low = np.insert(self.low, spot, at[inside])

    def row(self, capacity: float, gain: float, cost: float) -> None:
        self.value = self.value + gain
        self.cut(capacity - self.value)
        full = np.where(self.moves, self.low + self.value, self.value) >= capacity
        self.value, self.moves = np.where(full, capacity, self.value), self.moves & ~full
        self.cut(cost - self.value)
        self.value = self.value - np.where(np.where(self.moves, self.low + self.value, self.value) >= cost, cost, 0.0)
        keep = np.append(True, (self.moves[1:] != self.moves[:-1]) | (self.value[1:] != self.value[:-1]))
        if not keep.all():
            self.low, self.moves, self.value = self.low[keep], self.moves[keep], self.value[keep]

    def at(self, level: float) -> float:
        i = int(np.searchsorted(self.low, level, side="right")) - 1
        return float(self.value[i] + (level if self.moves[i] else 0.0))


def effect(capacity: float, gains: np.ndarray, costs: np.ndarray) -> dict:
    """What a block makes of the level at its first row (refilled already): one level, or its rows, and pieces as well if they are exact and not too many."""
    known = np.flatnonzero(gains[1:] >= capacity)
    if len(known):
        a = int(known[-1]) + 1
        return {"low": [0.0], "moves": [False], "value": [float(levels(capacity, gains[a:], costs[a:], 0.0)[1][-1])], "gains": None, "costs": None}
    rows = {"low": None, "gains": gains, "costs": costs}
    if not on_grid(capacity, gains[1:], costs):
        return rows
    made = Pieces.same()
    for gain, cost in zip([0.0, *gains[1:].tolist()], costs.tolist()):
        made.row(capacity, gain, cost)
        if len(made.low) > PIECES:
            return rows
    return rows | {"low": made.low.tolist(), "moves": made.moves.tolist(), "value": made.value.tolist()}


def applied(capacity: float, effect: dict, level: float) -> float:
    """The level after a block with that effect, as a plain walk from ``level`` rounds it."""
    if effect["low"] is None or (effect["gains"] is not None and not on_grid(level)):
        return float(levels(capacity, np.append(0.0, effect["gains"][1:]), np.array(effect["costs"]), level)[1][-1])
    return Pieces(*(np.array(effect[k]) for k in ("low", "moves", "value"))).at(level)


def token_bucket(
    log: DataFrame, request_capacity: float, request_refill: float, token_capacity: float, token_refill: float, key: str = "key", ts: str = "ts", order: str = "event_id", tokens: str = "tokens", block: int = BLOCK
) -> DataFrame:
    """log with admitted, request_level and token_level: each key has a bucket of requests and one of tokens, full at its first request.

    A request passes if both hold its cost; each bucket is charged on its own, even if the other refuses. Tokens that are null
    or NaN cost nothing. Null keys are one key; rows without a time come first and refill nothing; an empty log stays empty. Capacities are positive. Levels
    are those of a plain walk to the last bit: where sums are rounded, a key's blocks are chained row by row in one task, two pairs of numbers a row.
    """
    sizes, rates = (float(request_capacity), float(token_capacity)), (request_refill, token_refill)
    kind = "struct<low: array<double>, moves: array<boolean>, value: array<double>, known: boolean>"
    names = log.columns
    timed = log.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    schema = described(timed, f"_part int, _block long, _n long, admitted boolean, request_level double, token_level double, _first long, _last long, _requests {kind}, _tokens {kind}, _gaps array<long>, _costs array<double>")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def columns(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        us = rows.column("_us").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        return us, amounts(rows.column(tokens))

    def gaps(us: np.ndarray, before: float | None) -> np.ndarray:
        """Microseconds since the row before; 0 for the first one, and where a time is missing."""
        gap = np.diff(us, prepend=np.nan if before is None else before)
        return np.where(np.isnan(gap), 0.0, gap)

    def paused(us: np.ndarray, before: float | None) -> np.ndarray:
        return gaps(us, before) / MICROS

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks as if each began with full buckets, and their effects."""
        part = TaskContext.get().partitionId()
        held, size, number, count = [], 0, 0, 0

        def closed() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            us, cost = columns(rows)
            pause = paused(us, None)
            costs = (np.ones(len(us)), cost)
            (a, requests), (b, left) = (levels(c, pause * r, x, c) for c, r, x in zip(sizes, rates, costs))
            made = [np.full(len(us), part, np.int32), np.full(len(us), number), count + np.arange(len(us)), a & b, requests, left]
            yield extended(rows, arrow, [pa.array(x) for x in made])
            ends = [None if np.isnan(x) else int(x) for x in (us[0], us[-1])]
            effects = [effect(c, pause * r, x) for c, r, x in zip(sizes, rates, costs)]
            values = {"_part": part, "_block": number, "_first": ends[0], "_last": ends[1]}
            values |= {name: {k: e.get(k) for k in ("low", "moves", "value")} | {"known": e["gains"] is None} for name, e in zip(("_requests", "_tokens"), effects)}
            if any(e["gains"] is not None for e in effects):
                values |= {"_gaps": gaps(us, None).astype(np.int64), "_costs": cost}
            yield end_row(rows, key, arrow, values)

        for rows, new in runs(batches, key):
            if new and held:
                yield from closed()
                held, size = [], 0
            if new:
                number, count = 0, 0
            at = 0
            while at < rows.num_rows:
                take = min(block - size, rows.num_rows - at)
                held.append(rows.slice(at, take))
                size, at = size + take, at + take
                if size >= block:
                    yield from closed()
                    number, count, held, size = number + 1, count + size, [], 0
        if held:
            yield from closed()

    def chained(state: tuple, row: tuple) -> tuple:
        """The levels at a block's first row, refilled, and those that it leaves."""
        begun, last, requests, left = state
        first, end, *effects, between, cost = row
        pause = 0.0 if last is None or first is None or first != first else (first - last) / MICROS
        entry = [min(c, x + pause * r) for c, x, r in zip(sizes, (requests, left), rates)]
        after = []
        for c, e, x, r, unit in zip(sizes, effects, entry, rates, (True, False)):
            e = {k: e[k] for k in ("low", "moves", "value", "known")} | {"gains": None, "costs": None}
            if not e["known"]:
                e |= {"gains": np.array(between) / MICROS * r, "costs": np.ones(len(cost)) if unit else np.array(cost)}
            after.append(applied(c, e, x))
        return (True, last if end is None or end != end else end, *after), (*entry, not begun)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, row by row in order, from the levels at their first rows."""
        spot, last, now = None, None, [0.0, 0.0]
        for batch in batches:
            codes = [batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("_key", "_at", "_in")]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in codes], axis=0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                rows = batch.slice(a, b - a)
                here = tuple(rows.column(c)[0].as_py() for c in ("_key", "_at", "_in"))
                us, cost = columns(rows)
                if here != spot:
                    spot, last, now = here, None, [rows.column(c)[0].as_py() for c in ("_r0", "_t0")]
                pause = paused(us, last)
                last = us[-1]
                (x, requests), (y, left) = (levels(c, pause * r, k, n) for c, r, k, n in zip(sizes, rates, (np.ones(len(us)), cost), now))
                now = [float(requests[-1]), float(left[-1])]
                yield pa.RecordBatch.from_arrays([*rows.select(names).columns, *map(pa.array, (x & y, requests, left))], [*names, *made])

    made = ["admitted", "request_level", "token_level"]
    walked = written(ranged(timed, [key], ["_us", order]).mapInArrow(walk, schema), "buckets")
    rows, ends = walked.where("_requests is null"), walked.where("_requests is not null").select(key, "_part", "_block", "_first", "_last", "_requests", "_tokens", "_gaps", "_costs")
    known = fold(small_batches(several(ends, key)), [key], ["_part", "_block"], lambda: (False, None, *sizes), chained, ["_first", "_last", "_requests", "_tokens", "_gaps", "_costs"], "_r0 double, _t0 double, _begin boolean")
    known = written(known.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), F.col("_block").alias("_in"), "_r0", "_t0", "_begin"), "levels")
    # A block that is the first of its stretch begins with full buckets unless the key's rows go on from another task: two stretches at most for each.
    begun = F.broadcast(known.where("_in = 0 and not _begin").select(F.col("_key").alias("_k"), F.col("_at").alias("_a")))
    marked = rows.join(begun, same({key: "_k", "_part": "_a"}) & (F.col("_block") == 0), "left")
    settled = marked.where("_block = 0 and _a is null").select(*log.columns, *made)
    left = marked.where("_block > 0 or _a is not null").drop("_k", "_a", *made, "_first", "_last", "_requests", "_tokens", "_gaps", "_costs")
    left = left.join(known.drop("_begin"), same({key: "_key", "_part": "_at", "_block": "_in"})).repartition("_key", "_at", "_in").sortWithinPartitions("_key", "_at", "_in", "_n")
    return settled.unionByName(left.mapInArrow(again, described(log, "admitted boolean, request_level double, token_level double")))

