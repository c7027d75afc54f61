"""Packing a request log into batches, by links from batch to batch.

Where a batch begins says where it ends: it takes requests until it has ``max_size`` or ``max_tokens``. So each row has a link
to the row where the next batch would begin if one began at it, and the batches of a stretch are found by following links
from one row: doubled again and again, they jump 1, 2, 4, ... batches over all rows at once. A stretch is followed from
its first row and from every row where the first batch of its own may begin, which is one of its first ``max_size``; such paths
soon meet the first one, and from there on their batches are the same but for their numbers.
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
from .fold import fold
from .stretches import described, end_row, extended, ranged, runs, same, several


class Links:
    """The links of a run of requests. ``open_tokens`` has what a batch that is still open at the end would hold.

    With ``times`` (NaN where there is none) a batch is also closed once the next request comes ``max_wait`` or more after its first.
    """

    def __init__(self, tokens: np.ndarray, max_size: int, max_tokens: float, times: np.ndarray | None = None, max_wait: float = np.inf):
        n = len(tokens)
        self.n, self.open_tokens = n, np.zeros(n)
        following, live = np.full(n, n), np.arange(n)
        for size in range(1, min(max_size, n) + 1):
            live = live[live + size <= n]
            self.open_tokens[live] += tokens[live + size - 1]  # in the order of the rows, as a plain sum
            full = (self.open_tokens[live] >= max_tokens) | (size >= max_size)
            if times is not None and max_wait < np.inf:
                full |= (times[np.minimum(live + size, n - 1)] - times[live] >= max_wait) & (live + size < n)
            following[live[full]] = live[full] + size
            live = live[~full]
            if not len(live):
                break
        # The last batch's beginning links to itself.
        last = following >= n
        self.jumps = [np.where(last, np.arange(n), following)]
        self.hops = (~last).astype(np.int64)
        while 1 << (len(self.jumps) - 1) < n:
            jump = self.jumps[-1]
            self.hops += self.hops[jump]
            self.jumps.append(jump[jump])

    @property
    def last(self) -> np.ndarray:
        """For each row, where the last batch begins if one begins at it; ``hops`` are the batches between."""
        return self.jumps[-1]

    def begins(self, at: int) -> np.ndarray:
        """Which rows begin a batch if ``at`` does."""
        out = np.zeros(self.n, bool)
        out[at] = True
        for jump in self.jumps:
            out[jump[out]] = True
        return out

    def meeting(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the first of its batches' beginnings that is one of ``begins`` (or the last there is), and how many batches lie before it."""
        jump = np.where(begins, np.arange(self.n), self.jumps[0])
        hops = (jump != np.arange(self.n)).astype(np.int64)
        for _ in range(len(self.jumps) - 1):
            hops += hops[jump]
            jump = jump[jump]
        return jump, hops


class Path:
    """Batches followed from row ``wait`` of a stretch on: ``number`` is the open batch's (from 0), ``size`` and ``tokens`` what it holds, ``since`` when it began."""

    def __init__(self, wait: int):
        self.wait, self.number, self.size, self.tokens, self.since = wait, -1, 0, 0.0, np.nan
        self.meet = self.shift = None

    def first(self, tokens: np.ndarray, max_size: int, max_tokens: float, times: np.ndarray, max_wait: float) -> int:
        """Where in these further rows the next batch begins, their number if in none; the open batch takes the rows before."""
        if self.number < 0:
            at = min(self.wait, len(tokens))
            self.wait -= at
            return at
        at = 0
        while at < len(tokens) and self.size < max_size and self.tokens < max_tokens and not times[at] - self.since >= max_wait:
            self.tokens += float(tokens[at])
            self.size, at = self.size + 1, at + 1
        return at

    def leave(self, number: int, links: Links, last: int, times: np.ndarray) -> None:
        """The batch that begins at row ``last`` is the last one and stays open."""
        self.number, self.size, self.tokens, self.since = number, links.n - last, float(links.open_tokens[last]), float(times[last])


def pack_batches(log: DataFrame, max_size: int = 10, max_tokens: float = 4000, max_wait: float | None = None, key: str = "key", order: tuple[str, ...] = ("ts", "event_id"), tokens: str = "tokens") -> DataFrame:
    """log with batch_id from 0 within each key: a batch takes requests until it has ``max_size`` or ``max_tokens``; the last may go over.

    With ``max_wait`` (seconds), a batch is also released before a request that comes that long or longer after its first one.
    Tokens that are null or NaN count as 0. Null keys are one key. Rows of equal ``order`` are taken in any order; an empty log stays empty.
    """
    if max_size < 1 or not max_tokens > 0:
        raise ValueError("an empty batch has room for a request: max_size is 1 or more, max_tokens positive")
    names = log.columns
    schema = described(log, "_part int, _n long, _batch long, _head array<double>, _paths array<struct<meet: long, shift: long, number: long, size: long, tokens: double, since: double>>, _times array<double>")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    wait = np.inf if max_wait is None else max_wait * 1e6

    def columns(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, times in microseconds or NaN) of rows."""
        cost = np.nan_to_num(rows.column(tokens).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf)
        if wait == np.inf:
            return cost, np.full(len(cost), np.nan)
        return cost, rows.column(order[0]).cast(pa.timestamp("us", rows.column(order[0]).type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.float64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, paths, n, head, seen = None, [], 0, [], []

        def closed() -> pa.RecordBatch:
            own = paths[0]
            made = [(p.meet, p.shift, *((own.number + p.shift, own.size, own.tokens, own.since) if p.meet is not None else (p.number, p.size, p.tokens, p.since))) for p in paths[: min(len(paths), n)]]
            made = [dict(zip(("meet", "shift", "number", "size", "tokens", "since"), m)) for m in made]
            return end_row(before, key, arrow, {"_part": part, "_head": head, "_times": seen, "_paths": made})

        for rows, new in runs(batches, key):
            if new:
                if before is not None:
                    yield closed()
                paths, n, head, seen = [Path(i) for i in range(max_size)], 0, [], []
                paths[0].meet, paths[0].shift = 0, 0
            before = rows
            cost, times = columns(rows)
            seen += times[: max_size - len(head)].tolist()
            head += cost[: max_size - len(head)].tolist()
            links, own = Links(cost, max_size, max_tokens, times, wait), paths[0]
            at = own.first(cost, max_size, max_tokens, times, wait)
            begins = links.begins(at) if at < len(cost) else np.zeros(len(cost), bool)
            fresh = own.number + np.cumsum(begins)
            met, hops = links.meeting(begins)
            for p in paths[1:]:
                if p.meet is None:
                    i = p.first(cost, max_size, max_tokens, times, wait)
                    if i < len(cost):
                        m = int(met[i])
                        p.leave(p.number + 1 + int(hops[i]), links, m, times)
                        if begins[m]:
                            p.meet, p.shift = n + m, p.number - int(fresh[m])
            if at < len(cost):
                own.leave(int(fresh[-1]), links, int(links.last[at]), times)
            yield extended(rows, arrow, [pa.array(np.full(len(cost), part, np.int32)), pa.array(n + np.arange(len(cost))), pa.array(fresh)])
            n += len(cost)
        if before is not None:
            yield closed()

    def chained(state: tuple, row: tuple) -> tuple:
        """The open batch before a stretch, where its own first one begins, and what that makes of its rows."""
        number, size, held, since = state
        first, times, paths = row
        entry, at = state, 0
        # A time that is missing comes back as null or NaN.
        times = [np.nan if x is None else x for x in times]
        while number >= 0 and at < len(first) and size < max_size and held < max_tokens and not times[at] - since >= wait:
            size, held, at = size + 1, held + float(first[at]), at + 1
        if at >= len(paths):  # the open batch takes the whole stretch
            return (number, size, held, since), (*entry, None, None)
        p = paths[at]
        begun = p["since"]
        return (number + 1 + p["number"], p["size"], p["tokens"], np.nan if begun is None else begun), (*entry, p["meet"], None if p["shift"] is None else number + 1 + p["shift"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of stretches' beginnings, in order, from what is known to come before them."""
        spot, path = None, None
        for batch in batches:
            place = [batch.column(c) for c in ("_key", "_at")]
            codes = [x.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in place]
            change = np.flatnonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                rows = batch.slice(a, b - a)
                here = (place[0][a].as_py(), place[1][a].as_py())
                if here != spot:
                    spot, path = here, Path(0)
                    path.number, path.size, path.tokens = (rows.column(c)[0].as_py() for c in ("_number", "_size", "_tokens"))
                    path.since = np.nan if rows.column("_since")[0].as_py() is None else rows.column("_since")[0].as_py()
                cost, times = columns(rows)
                links = Links(cost, max_size, max_tokens, times, wait)
                at = path.first(cost, max_size, max_tokens, times, wait)
                begins = links.begins(at) if at < len(cost) else np.zeros(len(cost), bool)
                made = path.number + np.cumsum(begins)
                if at < len(cost):
                    path.leave(int(made[-1]), links, int(links.last[at]), times)
                yield pa.RecordBatch.from_arrays([*rows.select(names).columns, pa.array(made)], [*names, "batch_id"])

    walked = written(ranged(log, [key], list(order)).mapInArrow(walk, schema), "packed")
    rows, ends = walked.where("_paths is null"), several(walked.where("_paths is not null").select(key, "_part", "_head", "_times", "_paths"), key)
    known = fold(ends, [key], ["_part"], lambda: (-1, 0, 0.0, np.nan), chained, ["_head", "_times", "_paths"], "_number long, _size long, _tokens double, _since double, _meet long, _shift long")
    # Two stretches at most for each task: one that began before it and one that ends after it.
    known = F.broadcast(known.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_number", "_size", "_tokens", "_since", "_meet", "_shift"))
    joined = rows.join(known, same({key: "_key", "_part": "_at"}), "left")
    settled = joined.where("_at is null or _n >= _meet").withColumn("batch_id", F.col("_batch") + F.coalesce("_shift", F.lit(0)))
    left = joined.where("_at is not null and (_meet is null or _n < _meet)").repartition("_key", "_at").sortWithinPartitions("_key", "_at", "_n")
    return settled.select(*log.columns, "batch_id").unionByName(left.mapInArrow(again, described(log, "batch_id long")))
