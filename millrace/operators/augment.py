"""Augmented variants: aspects, checks, replacement, and the three strategies.

Variants, alternatives and similarity answers come as tables; nothing calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import text as T
from ..functions.scoring import parse_score
from ..sources.scratch import written
from .stretches import positions

#: Terms that count as aspects wherever they occur.
ASPECTS = [
    "quality", "price", "cost", "value", "design", "appearance", "performance", "speed", "reliability", "durability", "features", "functionality", "usability", "interface", "battery", "display",
    "size", "weight", "color", "style", "brand", "packaging", "service", "support", "help", "assistance", "response", "delivery", "shipping", "installation", "setup", "training", "documentation",
    "warranty", "guarantee", "refund", "return", "exchange", "experience", "satisfaction", "convenience", "ease", "simplicity", "comfort", "safety", "security", "privacy", "trust", "confidence",
]
PROPER = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:[\t-\r\x1c-\x20]+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"
GENERIC = r"(?iu)(?<![\p{L}\p{N}_])(?:app|software|device|product|service|system|platform)(?![\p{L}\p{N}_])"
#: What [A-Za-z] matches where case is ignored: two more letters of each case.
LETTER = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
#: A mark that is no word, letter or blank; in a text it stands for any other such character.
MARK, OTHER = "\ue000", "\ue001"
VALID = 0.8


def _trie(terms: list[str]) -> str:
    """A pattern that matches the longest of ``terms`` at a place, letter by letter."""
    heads: dict[str, list[str]] = {}
    for term in terms:
        heads.setdefault(term[0], []).append(term[1:])
    parts = []
    for letter, rests in heads.items():
        own = letter if letter.isalnum() else f"\\{letter}"
        more = [r for r in rests if r]
        parts.append(own + ((f"{_trie(more)}?" if "" in rests else _trie(more)) if more else ""))
    return f"(?:{'|'.join(parts)})"


def terms_in(text: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that occur anywhere in the text, in one pass over it; they may overlap."""
    terms = sorted({x for x in terms if x})
    if not terms:
        return F.array().cast("array<string>")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_trie(terms)}))"), F.lit(1)))
    # Only the longest term at a place is found: the terms that it begins with are there as well.
    inner = {x: [y for y in terms if x.startswith(y)] for x in terms}
    if any(len(v) > 1 for v in inner.values()):
        pairs = [F.lit(k) if i == 0 else F.array(*map(F.lit, v)) for k, v in inner.items() for i in (0, 1)]
        found = F.flatten(F.transform(found, lambda x: F.element_at(F.create_map(*pairs), x)))
    return found


def letter_runs(text: Column) -> Column:
    """Runs of words of two letters or more with only white space between them, as the pattern for capitalised words finds them where case is ignored.

    Each such word is marked, and marks with white space between them go; no pattern repeats a group, so no text is too long.
    """
    bare = F.translate(text, MARK, OTHER)
    marked = F.regexp_replace(bare, rf"(?<![\p{{L}}\p{{N}}_])({LETTER}{{2,}})(?![\p{{L}}\p{{N}}_])", f"{MARK}$1{MARK}")
    joined = F.regexp_replace(marked, rf"{MARK}({T.BLANK}+){MARK}", "$1")
    return F.regexp_extract_all(joined, F.lit(f"{MARK}([^{MARK}]*){MARK}"), F.lit(1))


def extract_aspects(text: Column, lexicon: list[str] = ASPECTS, proper: bool | str = True) -> Column:
    """Sorted distinct aspects: lexicon terms anywhere in the text, runs of capitalised words (with ``proper``), and words such as product or system.

    With ``proper="compat"`` a run may have any case, so that every run of words of two letters or more counts: what follows if case is ignored
    in the pattern for capitalised words.
    """
    parts = [terms_in(F.lower(text), lexicon), F.transform(F.regexp_extract_all(text, F.lit(GENERIC), F.lit(0)), F.lower)]
    if proper == "compat":
        parts.append(F.transform(letter_runs(text), F.lower))
    elif proper:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), F.lower))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def aspect_preservation(aspects: Column, variant: Column) -> Column:
    """Share of aspects that the variant holds; 1 for none."""
    low = F.lower(variant)
    return F.when(F.size(aspects) == 0, 1.0).otherwise(F.size(F.filter(aspects, lambda a: F.contains(low, F.lower(a)))) / F.size(aspects))


def answered(rows: DataFrame, similarity: DataFrame, keys: list[str] = ["sample_id", "strategy", "variant_index"]) -> DataFrame:
    """rows with ``_answers``, all answers of the row's first key, so that rows dealt by it are not dealt anew by all keys."""
    lists = similarity.groupBy(keys[0]).agg(F.collect_list(F.struct(*keys[1:], "response")).alias("_answers"))
    return rows.join(lists, keys[0], "left")


def validate_variants(variants: DataFrame, similarity: DataFrame | None, keys: list[str] = ["sample_id", "strategy", "variant_index"]) -> DataFrame:
    """variants (aspects, variant) with score = mean of preservation and similarity (0.5 without an answer) and is_valid; without ``similarity``, they are ``answered`` already."""
    rows = variants if similarity is None else answered(variants, similarity, keys)
    names = {k: f"_own_{k}" for k in keys[1:]}
    rows = rows.withColumns({v: F.col(k) for k, v in names.items()})

    def own(x: Column) -> Column:
        same = F.lit(True)
        for k, v in names.items():
            same = same & (x[k] == F.col(v))
        return same

    rows = rows.withColumn("_answer", F.explode_outer(F.filter("_answers", own))).withColumn("response", F.col("_answer.response"))
    score = (aspect_preservation(F.col("aspects"), F.col("variant")) + parse_score(F.col("response"), 0.5)) / 2
    return rows.withColumn("score", score).withColumn("is_valid", F.col("score") >= VALID).drop("response", "_answers", "_answer", *names.values())


def accept_variants(validated: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    return validated.where((F.col("variant") != "") & (F.col("variant") != F.col("text")) & F.col("is_valid") & (F.col("score") >= min_similarity))


def identify_changes(original: Column, variant: Column, aspects: Column) -> Column:
    """Sorted "added: w" and then "removed: w" for words that only one text has, aspects apart."""
    a, b = T.words(F.lower(original)), T.words(F.lower(variant))
    skip = F.transform(aspects, F.lower)
    line = lambda name, x: F.transform(F.array_sort(F.array_except(x, skip)), lambda w: F.concat(F.lit(name), w))
    return F.concat(line("added: ", F.array_except(b, a)), line("removed: ", F.array_except(a, b)))


def replace_aspect(text: Column, old: Column, new: Column) -> Column:
    """Every whole-word occurrence of ``old``, in any case, becomes ``new``."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), old, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_replace(text, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1"))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(T.strip(text), '^"+|"+$', "")


def unwrapped(text: Column) -> Column:
    """Without white space at both ends and then without the pair of quotes around it all; a quote at one end alone is the text's own."""
    return F.regexp_replace(T.strip(text), r'(?s)\A"(.*)"\z', "$1")


def cda_variants(samples: DataFrame, variants: DataFrame, similarity: DataFrame, lexicon: list[str] = ASPECTS, min_similarity: float = 0.8, proper: bool | str = True) -> DataFrame:
    """Accepted paraphrases (sample_id, variant_index, variant, score, changes, preserved)."""
    rows = samples.join(variants.where("strategy = 'CDA'").select("sample_id", "strategy", "variant_index", unwrapped(F.col("text")).alias("variant")), "sample_id").withColumn("aspects", extract_aspects(F.col("text"), lexicon, proper))
    good = accept_variants(validate_variants(rows, similarity), min_similarity)
    return good.select("sample_id", "strategy", "variant_index", "variant", "score", identify_changes(F.col("text"), F.col("variant"), F.col("aspects")).alias("changes"), F.col("aspects").alias("preserved"))


def choices(alternatives: DataFrame) -> DataFrame:
    """(aspect, product, choices): the cleaned alternatives of each aspect, and of each of its products if the table has them (null: any product), in the order of ``rank`` if there is one, then of the alphabet."""
    clean = F.lower(_unquoted(F.col("alternative")))
    rows = alternatives.select(
        "aspect",
        (F.col("product") if "product" in alternatives.columns else F.lit(None)).cast("string").alias("product"),
        (F.col("rank") if "rank" in alternatives.columns else F.lit(0)).cast("long").alias("rank"),
        clean.alias("alternative"),
    ).where("alternative <> '' AND alternative <> lower(aspect)")
    rows = rows.groupBy("aspect", "product", "alternative").agg(F.min("rank").alias("rank"))
    return rows.groupBy("aspect", "product").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "alternative"))), lambda x: x["alternative"]).alias("choices"))


def with_alternative(rows: DataFrame, alternatives: DataFrame, turn: Column) -> DataFrame:
    """rows (aspect, maybe product) with ``alternative``: of the aspect's choices for the product, or else for any product, the one whose turn it is; they come round again.

    Rows without a choice are left out. ``turn`` counts from 0.
    """
    table = choices(alternatives)
    any_ = table.where("product is null").select("aspect", F.col("choices").alias("_any"))
    rows = rows.withColumn("_turn", turn).join(any_, "aspect", "left")
    if "product" in rows.columns:
        own = table.where("product is not null").select("aspect", "product", F.col("choices").alias("_own"))
        rows = rows.join(own, ["aspect", "product"], "left").withColumn("_any", F.coalesce("_own", "_any")).drop("_own")
    return rows.where("_any is not null").withColumn("alternative", F.element_at("_any", (F.col("_turn") % F.size("_any") + 1).cast("int"))).drop("_any", "_turn")


def ada_variants(samples: DataFrame, alternatives: DataFrame, similarity: DataFrame, n: int = 3, lexicon: list[str] = ASPECTS, min_similarity: float = 0.8, proper: bool | str = True) -> DataFrame:
    """Accepted texts with one aspect replaced, the i-th variant taking the i-th aspect in turn, and the r-th alternative the r-th time that an aspect comes round."""
    # Answers come before a sample has variants: its text is dealt once, and no variant is.
    rows = answered(samples, similarity).withColumn("all_aspects", extract_aspects(F.col("text"), lexicon, proper)).where("size(all_aspects) > 0").withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("aspect", F.element_at("all_aspects", (F.col("variant_index") % F.size("all_aspects") + 1).cast("int")))
    rows = with_alternative(rows, alternatives, F.floor(F.col("variant_index") / F.size("all_aspects"))).withColumn("strategy", F.lit("ADA"))
    rows = rows.withColumn("variant", replace_aspect(F.col("text"), F.col("aspect"), F.col("alternative"))).withColumn("aspects", F.array_remove("all_aspects", F.col("aspect")))
    good = accept_variants(validate_variants(rows, None), min_similarity)
    change = F.concat(F.lit("replaced '"), F.col("aspect"), F.lit("' with '"), F.col("alternative"), F.lit("'"))
    return good.select("sample_id", "strategy", "variant_index", "variant", "score", F.array(change).alias("changes"), F.col("aspects").alias("preserved"))


def cada_plan(n: Column) -> list[Column]:
    """How many variants of each kind: cda, ada, combined."""
    cda = F.greatest(F.lit(1), F.floor(n / 2))
    return [cda.alias("cda"), (n - cda).alias("ada"), F.when(n > 3, F.least(F.lit(2), F.floor(n / 3))).otherwise(0).alias("combined")]


def cada_variants(samples: DataFrame, variants: DataFrame, alternatives: DataFrame, similarity: DataFrame, n: int = 4, lexicon: list[str] = ASPECTS, proper: bool | str = True) -> DataFrame:
    """Paraphrases, replacements and replacements in paraphrases, as ``cada_plan`` divides n."""
    n_cda, n_ada = max(1, n // 2), n - max(1, n // 2)
    n_both = min(2, n // 3) if n > 3 else 0
    marked = lambda df, name: df.withColumn("kind", F.lit(name)).withColumn("changes", F.transform("changes", lambda c: F.concat(F.lit(f"{name}: "), c)))
    # Read twice, and its joins' shuffle files are gone before the others' come.
    cda = written(cda_variants(samples, variants, similarity, lexicon, proper=proper).where(F.col("variant_index") < n_cda), "cda")
    ada = ada_variants(samples, alternatives, similarity, max(1, n_ada), lexicon, proper=proper).where(F.col("variant_index") < n_ada)
    out = marked(cda, "CDA").unionByName(marked(ada, "ADA"))
    both = cda.where(F.col("variant_index") < n_both).withColumn("aspect", F.try_element_at(extract_aspects(F.col("variant"), lexicon, proper), F.lit(1)))
    if "product" in samples.columns:
        both = both.join(samples.select("sample_id", "product"), "sample_id")
    both = with_alternative(both, alternatives, F.lit(0))
    both = both.withColumn("combined", replace_aspect(F.col("variant"), F.col("aspect"), F.col("alternative"))).where("combined <> variant")
    both = both.select("sample_id", "strategy", "variant_index", F.col("combined").alias("variant"), "score", F.array(F.lit("Combined context and aspect changes")).alias("changes"), "preserved", F.lit("COMBINED").alias("kind"))
    return out.unionByName(both)


def select_for_augmentation(samples: DataFrame, ratio: float, job: list[str], seq: str = "seq") -> DataFrame:
    """The first min(n, max(1, int(n * ratio))) samples of each job; none for ratio 0.

    Samples are counted by ranges of (job, seq), so a job of any size lies in many tasks: those of its ranges before the boundary are taken whole, and only
    in the range that holds it a sample's place decides.
    """
    if ratio <= 0:
        return samples.limit(0)
    rows, ends = positions(samples, job, [seq])
    sizes = ends.groupBy("_key").agg(F.sum("_rows").alias("_size"))
    take = F.least(F.col("_size"), F.greatest(F.lit(1), F.floor(F.col("_size") * ratio))) - F.col("_rows_before")
    taken = ends.join(sizes, "_key").select("_key", "_part", take.alias("_take")).where("_take > 0")
    return rows.join(taken, ["_key", "_part"]).where(F.col("_n") < F.col("_take")).select(*samples.columns)


def build_augmented_samples(accepted: DataFrame, samples: DataFrame) -> DataFrame:
    """Sample rows of accepted variants, with ids that depend on (sample, strategy, index) and metadata."""
    rows = accepted.join(samples.select("sample_id", "prompt_version"), "sample_id")
    return rows.select(
        F.md5(F.concat_ws("|", "sample_id", "strategy", "variant_index")).alias("id"),
        F.col("variant").alias("text"),
        F.concat("prompt_version", F.lit("_aug_"), "strategy").alias("prompt_version"),
        R.tokens_from_words(T.word_count(F.col("variant"))).alias("tokens_estimated"),
        F.struct(F.col("strategy").alias("augmentation_strategy"), F.col("score").alias("quality_score"), F.col("sample_id").alias("original_sample_id"), "variant_index", F.col("preserved").alias("preserved_aspects"), F.col("changes").alias("changed_elements")).alias("metadata"),
    )


def augment_dataset(samples: DataFrame, variants: DataFrame, alternatives: DataFrame, similarity: DataFrame, strategies: list[str], ratio: float, job: list[str], n: int = 2, lexicon: list[str] = ASPECTS, proper: bool | str = True) -> DataFrame:
    """The samples and what the strategies make of the first ``ratio`` of each job; unknown strategies are skipped."""
    chosen = select_for_augmentation(samples, ratio, job)
    made = {
        "CDA": lambda: cda_variants(chosen, variants, similarity, lexicon, proper=proper).where(F.col("variant_index") < n),
        "ADA": lambda: ada_variants(chosen, alternatives, similarity, n, lexicon, proper=proper),
        "CADA": lambda: cada_variants(chosen, variants, alternatives, similarity, n, lexicon, proper).drop("kind"),
    }
    out = samples.select(F.col("sample_id").alias("id"), "text", "prompt_version", "tokens_estimated")
    for s in strategies:
        if s in made:
            new = build_augmented_samples(made[s]().withColumn("strategy", F.lit(s)), samples)
            out = out.unionByName(new.select("id", "text", "prompt_version", "tokens_estimated"))
    return out


def augmentation_summary(samples: DataFrame, accepted: DataFrame, strategies: list[str], requested: int, lexicon: list[str] = ASPECTS, proper: bool | str = True) -> DataFrame:
    """For each sample and strategy: texts and scores by variant, the aspects that every variant preserved, what changed, and the mean score.

    A sample without variants has an empty row of score 0 that preserves all its aspects.
    """
    every = samples.select("sample_id", extract_aspects(F.col("text"), lexicon, proper).alias("aspects"), F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))
    accepted = written(accepted, "accepted")
    rows = F.array_sort(F.collect_list(F.struct("variant_index", "variant", "score", "preserved", "changes")))
    made = accepted.groupBy("sample_id", "strategy").agg(rows.alias("made"), F.count("*").alias("successful"), F.avg("score").alias("avg_score"))
    each = lambda name: F.transform("made", lambda x: x[name])
    preserved = F.aggregate("made", F.col("aspects"), lambda kept, x: F.array_intersect(kept, x["preserved"]))
    return every.join(made, ["sample_id", "strategy"], "left").select(
        "sample_id",
        "strategy",
        F.coalesce(each("variant"), F.expr("cast(array() as array<string>)")).alias("texts"),
        F.coalesce(each("score"), F.expr("cast(array() as array<double>)")).alias("scores"),
        F.coalesce(preserved, "aspects").alias("preserved"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(each("changes")))), F.expr("cast(array() as array<string>)")).alias("changed"),
        F.lit(requested).alias("requested"),
        F.coalesce("successful", F.lit(0)).alias("successful"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
    )
