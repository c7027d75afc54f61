"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, adjacent word pairs and pairs with one
or two words between. FTRL-proximal keeps a learning rate for each weight and drives most weights to zero
(L1), so what remains is small enough to send to every executor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts

#: ASCII other than letters and digits separates words; bytes of other scripts belong to them.
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def features(text: str | None, bits: int) -> np.ndarray:
    """Feature numbers below 2**bits, with repeats: words, then pairs at distance 1, 2 and 3."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_BREAKS).split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    parts = [hashes * _SALTS[0]]
    for gap in (1, 2, 3):
        parts.append((hashes[:-gap] * _SALTS[0] ^ (hashes[gap:] * _SALTS[gap] >> np.uint64(7))) * _SALTS[gap])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights (mostly zero) and bias after ``epochs`` passes over (distinct features, label) in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    step = lambda z, n: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    bias = lambda: -bias_z * alpha / (beta + bias_n**0.5)  # noqa: E731  not regularised
    for _ in range(epochs):
        for at, label in rows:
            zs, ns = z[at], n[at]
            w, b = step(zs, ns), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            more = np.sqrt(ns + g * g)
            z[at] = zs + g - (more - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
            grown = (bias_n + g * g) ** 0.5
            bias_z += g - (grown - bias_n**0.5) / alpha * b
            bias_n += g * g
    return step(z, n), float(bias())


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_docs: int = 6_000,
    bits: int = 20,
    epochs: int = 5,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 1.0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, their non-zero weights, bias), fitted on at most ``max_docs`` labelled rows.

    The rows are those of smallest id hash among ``labels`` with a label of 0 or 1. Their
    features, not their texts, go to one task, as FTRL is sequential; both that and the weights are bounded by
    ``max_docs`` and ``bits``. Without labelled rows, or with labels of one kind, the bias says what there is.
    """
    df = whole_texts(df)
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_docs)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(picked), "_id")

    @F.arrow_udf("array<int>")
    def distinct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.unique(features(x.as_py(), bits)).astype(np.int32) for x in batch], pa.list_(pa.int32()))

    def fit(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["_id"].to_numpy(), table["h"].to_numpy()))
        ends, flat = [], []
        for chunk in table["f"].chunks:
            flat += [x.values.to_numpy() for x in chunk]
        y = table["_label"].to_numpy()
        weights, bias = ftrl([(flat[i], int(y[i])) for i in order], bits, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(weights)
        return pa.table({"i": pa.array(np.append(at, -1), pa.int32()), "w": pa.array(np.append(weights[at], bias), pa.float64())})

    made = rows.select(F.lit(1).alias("one"), "_id", F.xxhash64("_id").alias("h"), "_label", distinct("_text").alias("f"))
    found = made.groupBy("one").applyInArrow(fit, "i int, w double").toArrow()
    if not found.num_rows:
        return np.empty(0, np.int64), np.empty(0), 0.0
    i, w = found["i"].to_numpy().astype(np.int64), found["w"].to_numpy()
    return i[i >= 0], w[i >= 0], float(w[i < 0][0])


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = 20, text: str = "text", name: str = "score") -> DataFrame:
    """df with the column ``name``: the probability, 0 to 1, that each whole text is toxic; null, empty and wordless texts get the bias alone."""
    df = whole_texts(df)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = shared.value
        weights = np.zeros(1 << bits, np.float32)
        weights[at] = w
        used = weights != 0
        for batch in batches:
            out = []
            for x in batch:
                found = features(x.as_py(), bits)
                out.append(weights[np.unique(found[used[found]])].sum(dtype=np.float64) + bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35))), pa.float64())

    return df.withColumn(name, run(F.col(text).cast("string")))
