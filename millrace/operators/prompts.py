"""Requests to prompts, costs and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import text as T

#: Answers of the offline stand-in; {p} is the product.
CANNED = [
    "I'm experiencing issues with {p} and need immediate assistance. The problem started yesterday and is affecting my productivity.",
    "Your {p} service is not working as expected. I've tried multiple troubleshooting steps but the issue persists.",
    "I'm frustrated with the recent changes to {p}. The new interface is confusing and has broken my workflow.",
    "There seems to be a bug in {p} that's preventing me from completing my tasks. Please investigate this urgently.",
    "The {p} feature I rely on daily has stopped working. This is impacting my business operations significantly.",
]
#: The texts of the prompt templates.
FEATURE = (
    "You are a user of {p} writing a feature request or improvement suggestion.\n\nYour request should:\n- Clearly describe the desired feature or improvement\n- Explain the problem it would solve\n"
    "- Provide context about your use case\n- Be constructive and specific\n- Include potential benefits for other users\n- Be between 60-180 words\n\nWrite your feature request:"
)
CHATBOT = (
    "You are a customer service representative responding to a customer inquiry about {p}.\n\nCustomer's issue: The customer is experiencing problems and needs assistance.\n\nYour response should be:\n"
    "- Professional and empathetic\n- Provide helpful troubleshooting steps\n- Offer clear next steps or solutions\n- Maintain a positive, solution-focused tone\n- Be concise but thorough (50-150 words)\n\nWrite your customer service response:"
)
FEW_SHOT_HEAD = "Here are some examples of the expected output:\n\n"
FEW_SHOT_TAIL = "Now generate your own response following the same pattern:"
WARN_COUNT, WARN_COST = 20, 1.0


def validate_requests(df: DataFrame, pricing: DataFrame, max_samples: int = 50, warn_cost: float = WARN_COST) -> DataFrame:
    """df with errors, warnings (many samples, a cost above ``warn_cost``), estimated_cost and is_valid."""
    priced = estimate_request_costs(df, pricing)
    errors = F.array_compact(
        F.array(
            F.when(~F.length("product").between(2, 200) | F.col("product").isNull(), "product"),
            F.when(~F.length("version").between(1, 20) | F.col("version").isNull(), "version"),
            F.when(~F.col("temperature").between(0.0, 2.0) | F.col("temperature").isNull(), "temperature"),
            F.when(F.col("count").isNull(), "count"),
            F.when((F.col("count") < 1) | (F.col("count") > max_samples), F.concat(F.lit("count over the limit of "), F.lit(str(max_samples)))),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("count") > WARN_COUNT, "many samples: may take several minutes"),
            F.when(F.col("estimated_cost") > warn_cost, F.concat(F.lit("high estimated cost: $"), F.format_string("%.2f", "estimated_cost"))),
        )
    )
    return priced.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


def estimate_cost(df: DataFrame, pricing: DataFrame, prompt_tokens: str = "prompt_tokens", completion_tokens: str = "completion_tokens") -> DataFrame:
    """df with ``cost`` by model; an unknown model has the default one's price; overrides (prompt_override, completion_override) count unless null or zero."""
    default = pricing.where(F.col("model") == R.DEFAULT_MODEL).select(F.col("prompt_per_1k").alias("_dp"), F.col("completion_per_1k").alias("_dc"))
    known = pricing.select(F.col("model").alias("_model"), F.col("prompt_per_1k").alias("_p"), F.col("completion_per_1k").alias("_c"))
    rows = df.join(known, F.col("model") == F.col("_model"), "left").join(F.broadcast(default.limit(1)), how="left")
    override = lambda c: F.nullif(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(None).cast("double")
    price = lambda o, own, d: F.coalesce(override(o), F.col(own), F.col(d))
    return rows.withColumn("cost", R.cost(F.col(prompt_tokens), F.col(completion_tokens), price("prompt_override", "_p", "_dp"), price("completion_override", "_c", "_dc"))).drop("_model", "_p", "_c", "_dp", "_dc")


def estimate_request_costs(df: DataFrame, pricing: DataFrame, completion_tokens: int = 200) -> DataFrame:
    """df with ``estimated_cost`` of all its samples, from the prompt it renders, to four places."""
    if "prompt" not in df.columns:
        df = df.withColumn("prompt", render_prompt())
    rows = df.withColumn("prompt_tokens", R.estimate_tokens(F.col("prompt"))).withColumn("completion_tokens", F.lit(completion_tokens))
    return estimate_cost(rows, pricing).withColumn("estimated_cost", F.round(F.col("cost") * F.col("count"), 4)).drop("cost")


def expand_requests(df: DataFrame) -> DataFrame:
    """One row for each sample of each request, with sample_index from 0."""
    return df.withColumn("sample_index", F.explode(F.when(F.col("count") > 0, F.sequence(F.lit(0), F.col("count") - 1)).otherwise(F.array().cast("array<int>"))))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def render_prompt() -> Column:
    """The prompt of columns product, template, sentiment_intensity, tone, min_length, max_length, constraints."""
    p, tone, level = F.col("product"), F.coalesce(F.col("tone"), F.lit("")), F.coalesce(F.col("sentiment_intensity"), F.lit(0))
    limit = R.length_constraint(F.col("min_length"), F.col("max_length"))
    extra = F.when(F.size(F.coalesce("constraints", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Additional requirements:\n"), F.array_join(F.transform("constraints", lambda c: F.concat(F.lit("- "), c, F.lit("\n"))), ""))).otherwise("")
    mood = F.when(level != 0, F.concat(F.lit("Sentiment Level: "), R.sentiment_description(level), F.lit("\n"))).otherwise("")
    voice = F.when(tone != "", F.concat(F.lit("Tone: "), tone, F.lit("\n"))).otherwise("")
    length = lambda other: F.when(limit != "", F.concat(F.lit("- Be "), limit)).otherwise(other)
    # The texts of the support and review templates.
    support = F.concat(
        F.lit("You are a customer writing a support request about a problem with "), p, F.lit(".\n\n"), mood, F.lit("\n"), voice, F.lit("\nYour request should be:\n- "),
        F.when(tone != "", F.concat(_capital(tone), F.lit(" in tone"))).otherwise("Professional and clear in tone"),
        F.lit("- Specific about the issue you're experiencing  \n- Include realistic details about the impact\n- Request clear next steps for resolution\n"),
        length("- Be between 50-150 words"), F.lit("\n"), extra, F.lit("\nWrite your support request:"),
    )
    review = F.concat(
        F.lit("You are a customer writing a review for "), p, F.lit(".\n\n"), mood, F.lit("\n"), voice, F.lit("\nYour review should be:\n- Authentic and helpful to other customers\n- Based on realistic usage experience\n"),
        F.when((level != 0) & (level <= 2), "- Focus on issues and problems while being constructive\n").when(level >= 4, "- Highlight positive aspects while maintaining credibility\n").otherwise("- Include both positive and negative aspects\n"),
        F.lit("- Be specific about features and performance\n- "),
        F.when(tone != "", F.concat(F.lit("Written in a "), tone, F.lit(" tone"))).otherwise("Written in a natural, conversational tone"),
        length("- Between 75-200 words"), F.lit("\n"), extra, F.lit("\nWrite your product review:"),
    )
    constant = lambda text: F.replace(F.lit(text), F.lit("{p}"), p)
    return T.strip(F.when(F.col("template") == "support", support).when(F.col("template") == "review", review).when(F.col("template") == "feature", constant(FEATURE)).otherwise(constant(CHATBOT)))


def few_shot_block(df: DataFrame, examples: DataFrame) -> DataFrame:
    """df with ``prompt`` preceded by its template's ``examples`` (template, position, context array<struct<k, v>>, output, note), {product} filled in."""
    item = F.struct("position", "context", "output", "note")
    by_template = examples.groupBy(F.col("template").alias("_t")).agg(F.array_sort(F.collect_list(item)).alias("_x"))
    one = lambda x, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\nInput: "), F.array_join(F.transform(x["context"], lambda c: F.concat(c["k"], F.lit(": "), c["v"])), ", "),
        F.lit("\nOutput: "), x["output"], F.lit("\n"), F.when(F.coalesce(x["note"], F.lit("")) != "", F.concat(F.lit("Note: "), x["note"], F.lit("\n"))).otherwise(""), F.lit("\n"),
    )
    block = F.concat(F.lit(FEW_SHOT_HEAD), F.array_join(F.transform("_x", one), ""), F.lit(FEW_SHOT_TAIL))
    rows = df.join(by_template, F.col("template") == F.col("_t"), "left")
    filled = F.concat(F.replace(block, F.lit("{product}"), F.col("product")), F.lit("\n\n"), F.col("prompt"))
    return rows.withColumn("prompt", F.when(F.col("_x").isNotNull(), filled).otherwise(F.col("prompt"))).drop("_t", "_x")


def assemble_samples(prompts: DataFrame, responses: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, prompts that got no response)."""
    joined = prompts.join(responses.withColumnRenamed("text", "response"), keys)
    samples = joined.withColumn("tokens_estimated", R.tokens_from_words(T.word_count(F.col("response"))))
    return samples, prompts.join(responses, keys, "left_anti")


def canned_response(prompt: Column, temperature: Column, max_tokens: Column, product: str = "the product") -> Column:
    """One of five answers by a hash of the prompt, cut to ``max_tokens`` words if given."""
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat(prompt, temperature.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(5)).cast("int")
    text = F.element_at(F.array(*[F.lit(t.replace("{p}", product)) for t in CANNED]), pick + 1)
    cut = F.array_join(F.slice(F.split(text, " "), F.lit(1), F.greatest(F.coalesce(max_tokens, F.lit(0)), F.lit(0))), " ")
    return F.when((F.coalesce(max_tokens, F.lit(0)) > 0) & (T.word_count(text) > max_tokens), cut).otherwise(text)


def generate(prompts: DataFrame, fn: Callable[[Iterator], Iterator] | None = None, schema: str | None = None) -> DataFrame:
    """Answers to a prompt table: ``fn`` maps batches (as for mapInPandas) to rows of ``schema``; without it, the offline stand-in adds ``text``."""
    if fn is None:
        return prompts.withColumn("text", canned_response(F.col("prompt"), F.col("temperature"), F.col("max_tokens")))
    return prompts.mapInPandas(fn, schema)
