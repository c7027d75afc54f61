"""Language identification by words first, then shorter and shorter character n-grams.

A word that the training rows know scores by its log frequency in each language. Any other
falls back to its 5-character grams; if none of those is known, to 4-character ones, and so on.
A text's score is the sum over its words; the prediction is the likeliest language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, whole_texts, written

NONE = "und"


def runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, pa.Array, np.ndarray]:
    """(runs of texts without blanks, how many each text has, words of each different run in a row, how many each of them has).

    A word is a run of letters and the marks on them of any length, in lower case, with one letter at least; a null text has no run.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    whole = lists.flatten().dictionary_encode()
    parts = pc.split_pattern_regex(whole.dictionary, r"[^\p{L}\p{M}]+")
    words = parts.flatten()
    full = pc.match_substring_regex(words, r"\p{L}")
    owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    sizes = np.bincount(owner, full.to_numpy(zero_copy_only=False), len(parts)).astype(np.int64)
    return whole, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), words.filter(full), sizes


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` rows each of ``values`` in order."""
    out = np.zeros((len(sizes), values.shape[1]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


@dataclass
class LanguageModel:
    """Log frequencies by language: for each length of n-grams, and for whole words under 0, the strings, one a line, and their rows.

    A string unknown to one language has that table's floor there.
    """

    langs: list[str]
    tables: dict[int, tuple[str, np.ndarray]]


def _grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def _table(counts: dict[str, Counter], langs: list[str]) -> tuple[str, np.ndarray]:
    """Add-half log frequencies over the union of what the languages kept."""
    union = sorted(set().union(*counts.values()))
    logs = np.empty((len(union), len(langs)), np.float32)
    for i, lang in enumerate(langs):
        own = counts[lang]
        logs[:, i] = np.log(np.array([own[k] for k in union]) + 0.5) - math.log(sum(own.values()) + 0.5 * (len(union) + 1))
    return "\n".join(union), logs


def train(
    df: DataFrame,
    lang: str = "lang",
    text: str = "text",
    id_col: str = "doc_id",
    max_docs: int = 4_000,
    max_words: int | None = None,
    max_grams: int | None = None,
    longest: int = 5,
    most_bytes: int = 256 << 20,
) -> LanguageModel:
    """Fit on df's rows with a language and a text: about ``max_docs`` of each language, picked by a hash of their id and text.

    All words and n-grams up to ``longest`` of these rows are kept, however many languages there are. What bounds the model, which is broadcast, is the number of rows alone: where its
    table of strings by languages would have more than ``most_bytes``, half as many rows of each language are taken, and so on. With ``max_words`` or ``max_grams`` only that many strings
    of each length are kept, the most frequent ones, an equal share of each language (ties by code point). No usable rows give a model of no language.
    """
    df = whole_texts(df)
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {})
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).unique():
                whole, _, found, sizes = runs(batch.column(1).filter(pc.equal(batch.column(0), own)))
                times = np.repeat(np.bincount(whole.indices.to_numpy(), minlength=len(sizes)), sizes)
                found = pa.table({"gram": found, "n": times}).group_by("gram").aggregate([("n", "sum")]).combine_chunks()
                for part in found.select(["gram", "n_sum"]).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * part.num_rows, pa.string()), *part.columns], ["lang", "gram", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for own, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in range(1, longest + 1):
                    for g in _grams(word, size):
                        found[own, size, g] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))] + [pa.array(list(found.values()), pa.int64())], ["lang", "size", "gram", "n"])

    while True:
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))])
        # By the text as well: rows without an id, or copies under one, are then not all in or all out.
        picked = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
        by_word = written(picked.select("lang", "text").mapInArrow(words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langwords")
        by_gram = written(by_word.mapInArrow(grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "langgrams")
        strings = by_word.select("gram").distinct().count() + by_gram.select("size", "gram").distinct().count()
        if strings * (4 * len(sizes) + 16) <= most_bytes or max_docs <= 1:
            break
        max_docs = max_docs // 2
    langs = sorted(sizes)

    def top(table: DataFrame, most: int | None) -> dict[int, dict[str, Counter]]:
        best: dict[int, dict[str, Counter]] = {}
        if most is not None:
            order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
            table = table.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most // len(langs))
        for r in table.select("lang", "size", "gram", "n").toLocalIterator():
            best.setdefault(r["size"], {own: Counter() for own in langs})[r["lang"]][r["gram"]] = r["n"]
        return best

    kept = top(by_word.withColumn("size", F.lit(0)), max_words) | top(by_gram, max_grams)
    tables = {n: _table(kept.get(n, {own: Counter() for own in langs}), langs) for n in range(longest + 1)}
    return LanguageModel(langs, tables)


def gram_hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of ``n`` code points."""
    out = np.zeros(max(0, len(letters) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + letters[i : len(letters) - n + 1 + i]
    return out ^ out >> np.uint64(31)


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Scorer:
    """Texts' sums of log frequencies, all different words of a group of texts at a time."""

    def __init__(self, model: LanguageModel):
        self.langs, self.tables = model.langs, {}
        for n, (names, logs) in model.tables.items():
            names = names.split("\n") if names else []
            if n:
                keys = gram_hashes(code_points(names), n)[::n] if names else np.empty(0, np.uint64)
                order = np.argsort(keys)
                self.tables[n] = keys[order], logs[order]
            else:
                self.tables[0] = pa.array(names, pa.string()), logs

    def words(self, words: pa.Array) -> np.ndarray:
        """The log frequencies of each word: its own if known, else the mean of those of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known, logs = self.tables[0]
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
        out[at >= 0] = logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(max(self.tables), 0, -1):
            keys, logs = self.tables[n]
            if not len(left) or not len(keys):
                continue
            names = words.take(pa.array(left)).to_pylist()
            names = [f"<{w}>" for w in names] if n > 1 else names
            size = np.array([len(w) for w in names])
            hashes = gram_hashes(code_points(names), n)
            owner = np.repeat(np.arange(len(names)), size)[: len(hashes)]
            inside = np.arange(len(hashes)) - (np.cumsum(size) - size)[owner] <= size[owner] - n
            hashes, owner = hashes[inside], owner[inside]
            found = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[found] == hashes
            hits = np.bincount(owner[hit], minlength=len(names))
            some = hits > 0  # as much weight as a word, however long it is
            out[left[some]] = (summed(logs[found[hit]], hits)[some] / hits[some, None]).astype(np.float32)
            left = left[~some]
        return out

    def score(self, texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[list[str], np.ndarray]]:
        """(languages, scores) of runs of texts of about ``most`` bytes."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            whole, many, words, sizes = runs(texts.slice(at, to - at))
            words = words.dictionary_encode()
            each = self.words(words.dictionary)[words.indices.to_numpy()] if self.langs else np.zeros((len(words), 0))
            by_run = np.column_stack([summed(each, sizes), sizes])
            total = summed(by_run[whole.indices.to_numpy()], many)
            like = total[:, :-1] - total[:, :-1].max(axis=1, initial=-np.inf, keepdims=True)
            like = np.exp(like)
            told = (total[:, -1] > 0) & bool(self.langs)
            best = like.argmax(axis=1) if self.langs else np.zeros(to - at, np.int64)  # ties: the first language by code point
            share = like[np.arange(to - at), best] / like.sum(axis=1) if self.langs else told
            yield [self.langs[i] if t else NONE for i, t in zip(best.tolist(), told.tolist())], np.where(told, share, 0.0)
            at = to


_scorers: dict[int, Scorer] = {}


def identify(df: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the columns ``pred`` and ``score`` for each whole text; columns of these names are replaced, all others stay.

    ``pred`` is a language of the model, or ``und`` (with score 0) if the text is null or has no
    letter, or the model has no language. ``score`` is the likeliest language's share, 0 to 1.
    """
    df = whole_texts(df)
    shared = df.sparkSession.sparkContext.broadcast(model)
    number = shared.id if hasattr(shared, "id") else id(shared)

    @F.arrow_udf("struct<p: string, s: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if number not in _scorers:
            _scorers.clear()
            _scorers[number] = Scorer(shared.value)
        for batch in batches:
            found = list(_scorers[number].score(batch))
            langs, shares = [x for part, _ in found for x in part], np.concatenate([np.empty(0), *(part for _, part in found)])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["p", "s"])

    name = unused(df, "told")
    found = df.withColumn(name, run(F.col(text).cast("string"))).withColumns({pred: F.col(name)["p"], score: F.col(name)["s"]})
    return found.drop(name)
