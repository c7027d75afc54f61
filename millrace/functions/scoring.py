"""Quality scores of texts as column expressions; each is between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: The keywords of each kind of template, in the order in which kinds are tried.
KEYWORDS = {
    "support": ["issue", "problem", "help", "support", "fix", "error"],
    "review": ["recommend", "experience", "quality", "rating", "using"],
    "feature": ["feature", "improvement", "add", "enhance", "would like"],
}
#: The weights of the parts of the overall score, in the order of their sum.
WEIGHTS = {"length": 0.15, "coherence": 0.25, "relevance": 0.25, "grammar": 0.15, "diversity": 0.10, "uniqueness": 0.10}
#: Word ranges and their scores.
LENGTH_BANDS = [(50, 200, 1.0), (30, 49, 0.8), (201, 300, 0.8), (20, 29, 0.6), (301, 400, 0.6), (10, 19, 0.4), (401, 500, 0.4)]
OTHER_LENGTH = 0.2
MOST_REPEATS = 5


def length_score(words: Column) -> Column:
    out = F.lit(OTHER_LENGTH)
    for low, high, score in LENGTH_BANDS:
        out = F.when(words.between(low, high), score).otherwise(out)
    return out


def parse_score(response: Column, default: float) -> Column:
    """The first number of an answer, at most 1; ``default`` without one."""
    number = F.regexp_extract(response, r"(\d+\.?\d*)", 1).try_cast("double")
    return F.when(number.isNull(), default).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def relevance_score(text: Column, product: Column, kind: Column) -> Column:
    """Share of the kind's keywords in the text; much more if the product is named."""
    low = F.lower(text)
    share = F.lit(0.0)
    for name, keys in reversed(KEYWORDS.items()):
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0))
        share = F.when(F.contains(kind, F.lit(name)), hits / len(keys)).otherwise(share)
    named = F.contains(low, F.lower(product))
    return F.when(F.coalesce(product, F.lit("")) == "", 0.5).when(named, F.least(0.8 + share * 0.2, F.lit(1.0))).otherwise(share * 0.6)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with what the grammar and diversity scores and the counts look at, each computed once: _words and _sorted (lower case), _parts and _found."""
    low = df.withColumn("_low", F.lower(text)).withColumns({"_words": T.words(F.col("_low")), "_found": F.regexp_extract_all(F.col("_low"), F.lit(T.WORD), F.lit(0)), "_parts": T.sentences(F.col(text))})
    return low.withColumn("_sorted", F.sort_array("_words")).drop("_low")


FEATURES = ("_words", "_sorted", "_parts", "_found")


def grammar_score(text: Column, parts: Column | None = None, ordered: Column | None = None) -> Column:
    """Share of checks passed: a capital at each sentence, a mark at the end, and one failed check for each word used over five times.

    ``parts`` and ``ordered`` are the text's ``features``, if they are there already.
    """
    parts = T.sentences(text) if parts is None else parts
    ordered = F.sort_array(T.words(F.lower(text))) if ordered is None else ordered
    starts = F.size(F.filter(parts, lambda s: F.rlike(s, F.lit(T.NOT_BLANK))))
    large = F.size(F.filter(parts, lambda s: F.rlike(s, F.lit(rf"^{T.BLANK}*\p{{Lu}}"))))
    ends = F.rlike(text, F.lit(rf"[.!?]{T.BLANK}*\z")).cast("int")
    # In sorted words, one seen over five times equals the word five places on.
    rest = F.greatest(F.size(ordered) - MOST_REPEATS, F.lit(0))
    again = F.filter(F.zip_with(F.slice(ordered, 1, rest), F.slice(ordered, MOST_REPEATS + 1, rest), lambda a, b: F.when(a == b, a)), lambda w: w.isNotNull())
    often = F.size(F.array_distinct(again))
    return F.greatest(1.0 - (starts - large + (1 - ends) + often) / (starts + 1 + often), F.lit(0.0))


def diversity_score(text: Column, found: Column | None = None) -> Column:
    """Different words to all, up to 0.7; ``found`` is the text's feature, if it is there already."""
    found = F.regexp_extract_all(F.lower(text), F.lit(T.WORD), F.lit(0)) if found is None else found
    return F.when(F.size(found) <= 1, 0.0).otherwise(F.least(F.size(F.array_distinct(found)) / F.size(found) / 0.7, F.lit(1.0)))


def uniqueness_score(reason: Column) -> Column:
    """By the reason for which a text is a duplicate; 1 for none."""
    return F.when(reason == "exact_duplicate", 0.0).when(reason == "normalized_duplicate", 0.2).when(reason == "semantic_similarity", 0.5).otherwise(1.0)


def overall_score(scores: dict[str, Column]) -> Column:
    total = None
    for name, weight in WEIGHTS.items():
        part = scores[name] * weight
        total = part if total is None else total + part
    return total


def score_samples(samples: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """samples with counts, the six scores and ``overall_score``; ``coherence`` (id, response) holds answers, 0.7 without."""
    rows = samples
    if coherence is not None:
        rows = rows.join(coherence.select(F.col("id").alias("_id"), "response"), F.col("id") == F.col("_id"), "left").drop("_id")
    else:
        rows = rows.withColumn("response", F.lit(None).cast("string"))
    text = F.col("text")
    rows = features(rows)
    rows = rows.withColumns({"word_count": F.size("_words"), "char_count": F.length("text"), "sentence_count": F.size("_parts")})
    rows = rows.withColumns(
        {
            "length_score": length_score(F.col("word_count")),
            "coherence_score": parse_score(F.col("response"), 0.7),
            "relevance_score": relevance_score(text, F.col("product"), F.col("template_type")),
            "grammar_score": grammar_score(text, F.col("_parts"), F.col("_sorted")),
            "diversity_score": diversity_score(text, F.col("_found")),
            "uniqueness_score": F.lit(1.0),
        }
    ).drop("response", *FEATURES)
    return rows.withColumn("overall_score", overall_score({n: F.col(f"{n}_score") for n in WEIGHTS}))
