"""Exact top-k search by a vector-approximation file.

Each component is cut into cells at quantiles of its shard, and a row keeps only the numbers of its cells, half a
byte each. For a query, a table holds the most that each cell of each component can add; a scan of the
cells sums these up and so bounds every row's inner product from above. Exact vectors are then read in the order
of that bound until no bound left can reach the k-th score, so the result is that of a full scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import blocked_top_k, exact_scores, usable


CELLS = 16


class Cells:
    """The approximation of ``rows``: ``pairs`` has the cells of two components in a byte, ``edges`` the least and largest value in each cell."""

    def __init__(self, rows: np.ndarray):
        n, dim = rows.shape
        marks = np.quantile(rows, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0)
        cells = np.zeros((dim + dim % 2, n), np.uint8)
        self.edges = np.zeros((dim + dim % 2, CELLS, 2))
        for d in range(dim):
            cells[d] = np.searchsorted(marks[:, d], rows[:, d], side="right")
            least, most = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
            np.minimum.at(least, cells[d], rows[:, d])
            np.maximum.at(most, cells[d], rows[:, d])
            used = least <= most
            self.edges[d, used, 0], self.edges[d, used, 1] = least[used], most[used]
        self.pairs = cells[::2] * CELLS + cells[1::2]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each row and query, what their inner product can be at most; exact for whole numbers."""
        asked = np.zeros((len(self.edges), len(queries)))
        asked[: queries.shape[1]] = queries.T
        adds = np.maximum(self.edges[:, :, :1] * asked[:, None], self.edges[:, :, 1:] * asked[:, None])
        out = np.zeros((self.pairs.shape[1], len(queries)))
        for i, pair in enumerate(self.pairs):
            out += np.take((adds[2 * i][:, None] + adds[2 * i + 1][None]).reshape(CELLS * CELLS, -1), pair, axis=0)
        return out


def va_index(step: int):
    """An index (see ``vectors.blocked_top_k``) that reads ``step`` exact vectors at a time in the order of their bounds."""

    def index(rows: np.ndarray):
        cells = Cells(rows)

        def nearest(query: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            found, scores, floor = np.empty(0, np.int64), np.empty(0), -np.inf
            left = np.arange(len(rows))
            while len(left):
                if len(left) > step:  # the largest bounds of those left
                    left = left[np.argpartition(-bound[left], step)]
                more, left = left[:step], left[step:]
                found = np.concatenate([found, more])
                scores = np.concatenate([scores, exact_scores(rows[more], query)])
                if len(scores) >= k:
                    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = scores >= floor
                    found, scores = found[keep], scores[keep]
                left = left[bound[left] >= floor]
            return found, scores

        def search(queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
            bounds = np.ascontiguousarray(cells.bounds(queries).T)
            return [nearest(q, b, k) for q, b in zip(queries, bounds)]

        return search

    return index


def exact_top_k(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    step: int = 256,
    shard_rows: int = 65_536,
    block_rows: int = 262_144,
) -> DataFrame:
    """The k rows of largest integer inner product for each query row: query_id, rank, vec_id, score.

    Each component x becomes floor(scale * x). Null and empty vectors, those with null or
    non-finite components and rows without an id take no part; zero vectors do. An empty table gives no
    rows. Ties go to the smaller id. Scores are exact while they stay below 2**53.
    """
    whole = usable(df, vector, zero=True).withColumn(vector, F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double")))
    return blocked_top_k(whole, id_col, vector, is_query, k, va_index(step), "long", shard_rows, block_rows)
