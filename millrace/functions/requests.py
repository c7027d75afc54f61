"""Checks, estimates and texts of generation requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each sentiment level is called in a prompt.
SENTIMENTS = {
    1: "Very Negative - Highly dissatisfied, angry, or frustrated",
    2: "Negative - Dissatisfied or disappointed",
    3: "Neutral - Balanced or indifferent",
    4: "Positive - Satisfied or pleased",
    5: "Very Positive - Extremely satisfied, delighted, or enthusiastic",
}
#: Fixed value: the model whose price counts for models that the price table lacks.
DEFAULT_MODEL = "gpt-4"


def sanitize_product(name: Column) -> Column:
    """Letters, digits, blanks and simple punctuation only, without blanks at the ends."""
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} .,!?\-_()\[\]{}]", ""))


def estimate_duration(count: Column) -> Column:
    """Seconds for ``count`` samples, five at a time."""
    return F.round(count / 5 * 2, 1)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def tokens_from_words(words: Column) -> Column:
    return F.floor(words * F.lit(1.3)).cast("int")


def rate_limit_tokens(prompt: Column, max_tokens: Column) -> Column:
    return (F.floor(F.length(prompt) / 4) + F.coalesce(max_tokens, F.lit(0))).cast("int")


def cost(prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Price of a call from prices for a thousand tokens."""
    return prompt_tokens / 1000 * prompt_price + completion_tokens / 1000 * completion_price


def sentiment_description(level: Column) -> Column:
    out = F.lit("Neutral")
    for k, name in SENTIMENTS.items():
        out = F.when(level == k, name).otherwise(out)
    return out


def length_constraint(low: Column, high: Column) -> Column:
    """The wanted length in words; a zero counts as not given."""
    least, most = F.coalesce(low, F.lit(0)) != 0, F.coalesce(high, F.lit(0)) != 0
    return (
        F.when(least & most, F.concat(F.lit("between "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" words")))
        .when(least, F.concat(F.lit("at least "), low.cast("string"), F.lit(" words")))
        .when(most, F.concat(F.lit("no more than "), high.cast("string"), F.lit(" words")))
        .otherwise("")
    )


def backoff_delay(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before a retry: doubled each time; ``jitter`` in [0, 1) spreads it by a tenth either way."""
    plain = F.when(attempt <= 0, 0.0).otherwise(F.least(F.pow(F.lit(2.0), attempt - 1) * base, F.lit(most)))
    return plain if jitter is None else F.greatest(plain * (0.9 + 0.2 * jitter), F.lit(0.0))


def progress_pct(done: Column, total: Column) -> Column:
    return F.floor(done / total * 100).cast("int")
