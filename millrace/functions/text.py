"""Words, normal forms and hashes of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode has them, the same in every regex engine.
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_BLANK = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WORD_OR_BLANK = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def sentences(text: Column) -> Column:
    """Parts between full stops, exclamation and question marks, empty ones included."""
    return F.split(text, "[.!?]+", -1)


def text_counts(text: Column) -> list[Column]:
    """word_count, char_count, sentence_count."""
    return [word_count(text).alias("word_count"), F.length(text).alias("char_count"), F.size(sentences(text)).alias("sentence_count")]


def normalize_text(text: Column) -> Column:
    """Lower case, word characters only, single blanks."""
    bare = F.regexp_replace(F.lower(text), NOT_WORD_OR_BLANK, "")
    return F.trim(F.regexp_replace(bare, BLANK + "+", " "))


def text_hash(text: Column) -> Column:
    return F.md5(normalize_text(text))


def word_set(text: Column) -> Column:
    """The distinct words of the normal form, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalize_text(text), " "), lambda w: w != "")))


def hashed_set(text: Column) -> Column:
    """The distinct words of the normal form as 64-bit hashes, sorted: for comparing sets, at a fraction of the bytes."""
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.split(normalize_text(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w))))
