"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives each vector one long hash string, 64 signs of random projections, and keeps
the strings in a sorted array. A query descends each tree to its longest matching prefix and
then ascends all trees together, one bit at a time, until the ranges that share its prefix hold
enough rows; those are scored exactly. Largest inner product becomes an angle by one more
component that gives every stored vector the same length, so the strings order by it.

At scale the table is cut into shards with a forest each (see ``vectors``). Vectors whose
strings are equal stay equal in every tree; copies are stored once with all their ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .vectors import blocked_top_k, exact_scores, usable

BITS = 64


def projections(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, dim, BITS))


def strings(vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """64 signs of projections as one unsigned number, the first sign highest."""
    powers = np.left_shift(np.uint64(1), np.arange(BITS - 1, -1, -1, dtype=np.uint64))
    return np.where(vectors @ plane > 0, powers, np.uint64(0)).sum(axis=1, dtype=np.uint64)


def longest(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many leading bits each asked string shares with the sorted string nearest to it: the depth of its descent."""
    at = np.searchsorted(sorted_keys, asked)
    apart = np.minimum(*(sorted_keys[np.clip(at - i, 0, len(sorted_keys) - 1)] ^ asked for i in (0, 1)))
    bits = np.zeros(len(asked), np.int64)
    for half in (32, 16, 8, 4, 2, 1):  # leading zeros
        clear = apart >> np.uint64(BITS - half) == 0
        bits[clear] += half
        apart = np.where(clear, apart << np.uint64(half), apart)
    return np.where(apart == 0, BITS, bits)


def forest_index(trees: int, reach: float, seed: int):
    """An index (see ``vectors.blocked_top_k``) that scores at least ``reach`` of all tree entries for a query."""

    def index(rows: np.ndarray):
        length = np.sqrt((rows * rows).sum(axis=1))
        largest = length.max()
        lifted = np.column_stack([rows / largest, np.sqrt(np.maximum(0, 1 - (length / largest) ** 2))])
        planes, orders, keys = projections(lifted.shape[1], trees, seed), [], []
        for plane in planes:
            key = strings(lifted, plane)
            orders.append(np.argsort(key, kind="stable"))
            keys.append(key[orders[-1]])
        least = reach * trees * len(rows)

        def search(queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
            asked = np.column_stack([queries / np.sqrt((queries * queries).sum(axis=1))[:, None], np.zeros(len(queries))])
            wanted = [strings(asked, plane) for plane in planes]
            deep = np.max([longest(key, w) for key, w in zip(keys, wanted)], axis=0)
            low, high = np.zeros((trees, len(queries)), np.int64), np.zeros((trees, len(queries)), np.int64)
            open_ = np.ones(len(queries), bool)
            for depth in range(int(deep.max()), 0, -1):  # from the longest match up, all trees together
                active = np.flatnonzero(open_ & (deep >= depth))
                rest = np.uint64((1 << (BITS - depth)) - 1)
                for t in range(trees):
                    q = wanted[t][active]
                    low[t, active] = np.searchsorted(keys[t], q & ~rest, side="left")
                    high[t, active] = np.searchsorted(keys[t], q | rest, side="right")
                open_[active] = (high - low)[:, active].sum(axis=0) < max(least, k)
                if not open_.any():
                    break
            low[:, open_], high[:, open_] = 0, len(rows)  # the root: every row
            return [nearest(q, low[:, j], high[:, j], k) for j, q in enumerate(queries)]

        def nearest(query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            seen = np.zeros(len(rows), bool)
            for order, a, b in zip(orders, low, high):
                seen[order[a:b]] = True
            found = np.flatnonzero(seen)
            rough = rows[found] @ query
            if len(found) > k:  # the final scores differ from these by rounding only
                floor = np.partition(rough, len(rough) - k)[len(rough) - k]
                found = found[rough >= floor - 1e-9 * max(1.0, abs(floor), np.abs(rough).max())]
            return found, exact_scores(rows[found], query)

        return search

    return index


def nearest_neighbours(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    trees: int = 16,
    reach: float = 0.08,
    shard_rows: int = 65_536,
    block_rows: int = 262_144,
    seed: int = 11,
) -> DataFrame:
    """The k rows of largest inner product found for each query row: query_id, rank, vec_id, score.

    ``reach`` is the share of all tree entries of a shard that a query's prefixes must hold, where a row counts once for
    each tree that reaches it. Null, empty and zero vectors, those with null or non-finite components and rows
    without an id take no part; an empty table gives no rows. Ties go to the smaller id. Recall
    grows with ``reach`` up to every row of a shard.
    """
    return blocked_top_k(usable(df, vector, zero=False), id_col, vector, is_query, k, forest_index(trees, reach, seed), "double", shard_rows, block_rows)
