"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton lists every vocabulary piece inside a word; dynamic programming over
the letters carries the best score and the number of pieces, nothing else. Ties fall as in the
tokenizers library's Unigram model: of equal scores at an end, the piece that starts first wins, and an
unknown letter comes last.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts

#: What the library takes off the lowest score for an unknown letter.
UNKNOWN_PENALTY = 10.0
BLANK = "▁"


class Counter:
    """Piece counts of words under (piece, score) pairs.

    With ``byte_fallback`` an unknown letter counts one piece for each of its UTF-8 bytes that way;
    otherwise a run of unknown letters is one piece.
    """

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool, cache: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        pieces = {piece for piece, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.limit, self.known = cache, {}

    def best(self, word: str) -> tuple[float, int]:
        """The best score of a segmentation of ``word`` and its number of pieces."""
        n = len(word)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        end, found = next(matches, (n, None))
        for at in range(n):
            top, pieces, single = None, 0, False
            while found is not None and end == at:  # longest first: the earliest start
                size, own = found
                value = own + score[at + 1 - size]
                if top is None or value > top:
                    top, pieces = value, count[at + 1 - size] + 1
                single = single or size == 1
                end, found = next(matches, (n, None))
            if not single:
                value = self.unknown + score[at]
                if top is None or value > top:
                    top = value
                    odd[at + 1] = True
                    pieces = count[at] + (len(word[at].encode("utf-8", "replace")) if self.bytes else 0 if odd[at] else 1)
            score[at + 1], count[at + 1] = top, pieces
        return score[n], count[n]

    def text(self, text: str | None) -> int:
        """Pieces of the words of a text, each with the blank mark before it."""
        words = (text or "").split()
        if len(self.known) > self.limit:
            self.known.clear()
        known, total = self.known, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = known[word] = self.best(BLANK + word)[1]
            total += n
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The pieces and scores of a SentencePiece file, taken as a unigram vocabulary with byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], byte_fallback=True)


def token_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with the long column ``name``: the number of tokens of each whole text, 0 for null, empty and blank ones.

    Words are split at white space. ``path`` is a SentencePiece vocabulary that every executor can open.
    """
    df = whole_texts(df)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for batch in batches:
            yield pa.array([own.text(x.as_py()) for x in batch], pa.int64())

    return df.withColumn(name, run(F.col(text).cast("string")))
