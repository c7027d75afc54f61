"""One query for each operator over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import scoring as S
from ..functions import text as T
from ..operators import accepted as C
from ..operators import augment as A
from ..operators import buckets as B
from ..operators import dedup as D
from ..operators import jobs as J
from ..operators import packing as K
from ..operators import prompts as P
from ..operators import quality as Q
from ..operators import usage as U
from ..sources.samples import assemble_parts, assemble_results, checked_samples, flatten_results, read_samples, write_samples
from ..sources.scratch import scratch_path
from ..streaming import streams as X
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


def samples_sql(columns: str, rest: str = "") -> str:
    return f"WITH {t.SAMPLES_SQL} SELECT {columns} FROM samples {rest}"


def scored_sql(columns: str, rest: str = "") -> str:
    return f"WITH {t.SCORED_SQL} SELECT {columns} FROM scored {rest}"


def wins_sql(src: str, columns: str, rest: str = "FROM reasons") -> str:
    return f"WITH RECURSIVE {t.SCORED_SQL}, src AS (SELECT seq, text, {src}), {t.first_wins_sql('src')} SELECT {columns} {rest}"


FIT = "FROM scored WHERE word_count BETWEEN 10 AND 500"
LABELLED = f"""WITH RECURSIVE {t.SCORED_SQL}, src AS (SELECT seq, text, overall_score >= 0.6::DOUBLE AS eligible {FIT}), {t.first_wins_sql('src')}, labelled AS (
  SELECT s.*, r.reason, CASE WHEN word_count NOT BETWEEN 10 AND 500 THEN 'failed_length' WHEN r.reason IS NOT NULL THEN 'failed_duplicate' WHEN overall_score < 0.6::DOUBLE THEN 'failed_quality' ELSE 'passed' END AS status
  FROM scored s LEFT JOIN reasons r ON r.seq = s.seq) """


# Sources and nested results


@query(samples_sql("seq, product, prompt_version, text, tokens_estimated"))
def s1_read_write(spark, d):
    path = scratch_path(spark, "samples")
    write_samples(t.samples(spark, d), path, "json")
    return read_samples(spark, path, "json").select("seq", "product", "prompt_version", "text", "tokens_estimated")


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'not readable' WHEN doc_id % 10 = 0 THEN 'tokens_estimated below 0' WHEN doc_id % 11 = 0 THEN 'missing text' ELSE '' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def s1_checked_samples(spark, d):
    """Every document as a JSON line, some cut off, some with a negative number of tokens, some without a text."""
    rows = t.samples(spark, d).select("seq", "id", "product", "prompt_version", F.when(F.col("seq") % 11 != 0, F.col("text")).alias("text"), F.when(F.col("seq") % 10 == 0, -1).otherwise(F.col("tokens_estimated")).alias("tokens_estimated"))
    line = F.to_json(F.struct(*rows.columns))
    path = scratch_path(spark, "lines")
    rows.select(F.when(F.col("seq") % 7 == 0, F.substring(line, 1, 10)).otherwise(line).alias("value")).write.text(path)
    good, bad = checked_samples(spark, path, "json", needed=("id", "text", "tokens_estimated"))
    kinds = good.select(F.lit("").alias("reason")).unionByName(bad.select(F.element_at("reasons", -1).alias("reason")))
    return kinds.groupBy("reason").agg(F.count("*").alias("n"))


@query(samples_sql("job_id, id AS sample_id, text, tokens_estimated"))
def s2_flatten_results(spark, d):
    jobs = assemble_parts(t.samples(spark, d), ["job_id"]).select("job_id", F.to_json(F.struct("samples", "total_samples")).alias("result"))
    return flatten_results(jobs)


@query(samples_sql("job_id, md5(string_agg(id, ',' ORDER BY seq)) AS ids, count(*) AS total_samples, sum(tokens_estimated)::BIGINT AS total_tokens_estimated", "GROUP BY job_id"))
def s3_assemble_results(spark, d):
    return assemble_results(t.samples(spark, d).drop("text"), ["job_id"]).select("job_id", F.md5(F.array_join("samples.id", ",")).alias("ids"), "total_samples", "total_tokens_estimated")


# Requests, cost and prompts


@query(r"SELECT p_partkey AS request_id, trim(regexp_replace(p_name || '#é<3> [x]', '[^\p{L}\p{N} .,!?\-_()\[\]{}]', '', 'g')) AS product FROM part")
def r1_sanitize_product(spark, d):
    return t.requests(spark, d).select("request_id", R.sanitize_product(F.concat("product", F.lit("#é<3> [x]"))).alias("product"))


# Fixed values, typed out once more, so that the SQL doesn't expect what the library happens to hold.
LEVEL_SQL = """CASE level WHEN 1 THEN 'Very Negative - Highly dissatisfied, angry, or frustrated' WHEN 2 THEN 'Negative - Dissatisfied or disappointed' WHEN 3 THEN 'Neutral - Balanced or indifferent'
  WHEN 4 THEN 'Positive - Satisfied or pleased' WHEN 5 THEN 'Very Positive - Extremely satisfied, delighted, or enthusiastic' ELSE 'Neutral' END"""
FEATURE_TEXT = """You are a user of {{p}} writing a feature request or improvement suggestion.

Your request should:
- Clearly describe the desired feature or improvement
- Explain the problem it would solve
- Provide context about your use case
- Be constructive and specific
- Include potential benefits for other users
- Be between 60-180 words

Write your feature request:"""
CHATBOT_TEXT = """You are a customer service representative responding to a customer inquiry about {{p}}.

Customer''s issue: The customer is experiencing problems and needs assistance.

Your response should be:
- Professional and empathetic
- Provide helpful troubleshooting steps
- Offer clear next steps or solutions
- Maintain a positive, solution-focused tone
- Be concise but thorough (50-150 words)

Write your customer service response:"""
CANNED_SQL = """['I''m experiencing issues with the product and need immediate assistance. The problem started yesterday and is affecting my productivity.',
  'Your the product service is not working as expected. I''ve tried multiple troubleshooting steps but the issue persists.',
  'I''m frustrated with the recent changes to the product. The new interface is confusing and has broken my workflow.',
  'There seems to be a bug in the product that''s preventing me from completing my tasks. Please investigate this urgently.',
  'The the product feature I rely on daily has stopped working. This is impacting my business operations significantly.']"""
PROMPT_SQL = f"""{t.REQUESTS_SQL}, moods AS (SELECT *, CASE WHEN level = 0 THEN '' ELSE 'Sentiment Level: ' || {LEVEL_SQL} || chr(10) END AS mood,
  CASE WHEN tone = '' THEN '' ELSE 'Tone: ' || tone || chr(10) END AS voice FROM requests), prompts AS MATERIALIZED (SELECT *, CASE template
  WHEN 'support' THEN 'You are a customer writing a support request about a problem with ' || product || '.' || chr(10) || chr(10) || mood || chr(10) || voice || chr(10) || 'Your request should be:' || chr(10) || '- ' || CASE WHEN tone = '' THEN 'Professional and clear in tone' ELSE 'Polite in tone' END
    || '- Specific about the issue you''re experiencing  ' || chr(10) || '- Include realistic details about the impact' || chr(10) || '- Request clear next steps for resolution' || chr(10) || CASE WHEN lim = '' THEN '- Be between 50-150 words' ELSE '- Be ' || lim END || chr(10) || extra || chr(10) || 'Write your support request:'
  WHEN 'review' THEN 'You are a customer writing a review for ' || product || '.' || chr(10) || chr(10) || mood || chr(10) || voice || chr(10) || 'Your review should be:' || chr(10) || '- Authentic and helpful to other customers' || chr(10) || '- Based on realistic usage experience' || chr(10)
    || CASE WHEN level IN (1, 2) THEN '- Focus on issues and problems while being constructive' WHEN level >= 4 THEN '- Highlight positive aspects while maintaining credibility' ELSE '- Include both positive and negative aspects' END || chr(10) || '- Be specific about features and performance' || chr(10) || '- '
    || CASE WHEN tone = '' THEN 'Written in a natural, conversational tone' ELSE 'Written in a ' || tone || ' tone' END || CASE WHEN lim = '' THEN '- Between 75-200 words' ELSE '- Be ' || lim END || chr(10) || extra || chr(10) || 'Write your product review:'
  WHEN 'feature' THEN replace('{FEATURE_TEXT}', '{{{{p}}}}', product) ELSE replace('{CHATBOT_TEXT}', '{{{{p}}}}', product) END AS prompt FROM moods),
prices AS (SELECT * FROM (VALUES ('gpt-4', 0.03::DOUBLE, 0.06::DOUBLE), ('gpt-3.5-turbo', 0.0015::DOUBLE, 0.002::DOUBLE), ('small', 0.5::DOUBLE, 1.5::DOUBLE)) v(model, p, c)),
costs AS MATERIALIZED (SELECT r.*, greatest(1, len(prompt) // 4)::INT AS prompt_tokens, greatest(1, len(prompt) // 4)::DOUBLE / 1000 * coalesce(x.p, 0.03::DOUBLE) + 200::DOUBLE / 1000 * coalesce(x.c, 0.06::DOUBLE) AS cost FROM prompts r LEFT JOIN prices x ON x.model = r.model)"""


@query(f"""WITH {PROMPT_SQL} SELECT request_id, round((cost * count)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS estimated_cost, CASE WHEN count > 30 THEN 1 ELSE 0 END::INT AS n_errors, (count > 20)::INT + (round((cost * count)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE > 0.5)::INT AS n_warnings, count <= 30 AS is_valid FROM costs""")
def r2_validate_requests(spark, d):
    rows = P.validate_requests(t.requests(spark, d), t.pricing(spark), max_samples=30, warn_cost=0.5)
    return rows.select("request_id", "estimated_cost", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "is_valid")


@query("SELECT p_partkey AS request_id, round(p_size::DOUBLE / 5 * 2, 1) AS seconds FROM part")
def r3_estimate_duration(spark, d):
    return t.requests(spark, d).select("request_id", R.estimate_duration(F.col("count")).alias("seconds"))


@query("SELECT doc_id, greatest(1, len(text) // 4)::INT AS tokens FROM documents")
def r4_estimate_tokens(spark, d):
    return t.table(spark, d, "documents").select("doc_id", R.estimate_tokens(F.col("text")).alias("tokens"))


@query(samples_sql("seq, trunc(word_count * 1.3::DOUBLE)::INT AS tokens"))
def r5_tokens_from_words(spark, d):
    return t.samples(spark, d).select("seq", R.tokens_from_words(T.word_count(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, (len(text) // 4 + CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 0 END)::INT AS tokens FROM documents")
def r6_rate_limit_tokens(spark, d):
    return t.table(spark, d, "documents").select("doc_id", R.rate_limit_tokens(F.col("text"), F.when(F.col("doc_id") % 2 == 0, 100)).alias("tokens"))


@query("""SELECT p_partkey AS request_id, round(p_size::DOUBLE / 1000 * CASE WHEN p_partkey % 4 = 1 THEN 0.2::DOUBLE WHEN p_partkey % 3 = 1 THEN 0.0015::DOUBLE ELSE 0.03::DOUBLE END
  + 200::DOUBLE / 1000 * CASE WHEN p_partkey % 3 = 1 THEN 0.002::DOUBLE ELSE 0.06::DOUBLE END, 6) AS cost FROM part""")
def r7_estimate_cost(spark, d):
    rows = t.requests(spark, d).withColumn("completion_tokens", F.lit(200)).withColumn("prompt_override", F.when(F.col("request_id") % 4 == 1, 0.2).when(F.col("request_id") % 4 == 2, 0.0))
    return P.estimate_cost(rows, t.pricing(spark), "count").select("request_id", r6("cost"))


@query(f"WITH {PROMPT_SQL} SELECT request_id, prompt_tokens, round((cost * count)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS estimated_cost FROM costs")
def r8_estimate_request_cost(spark, d):
    return P.estimate_request_costs(t.requests(spark, d), t.pricing(spark)).select("request_id", "prompt_tokens", "estimated_cost")


@query("SELECT p_partkey AS request_id, unnest(range(0, p_size))::INT AS sample_index FROM part")
def r9_expand_requests(spark, d):
    return P.expand_requests(t.requests(spark, d)).select("request_id", "sample_index")


@query(f"WITH {t.REQUESTS_SQL} SELECT request_id, {LEVEL_SQL} AS sentiment, lim AS length FROM requests")
def r10_descriptions(spark, d):
    return t.requests(spark, d).select("request_id", R.sentiment_description(F.col("sentiment_intensity")).alias("sentiment"), R.length_constraint(F.col("min_length"), F.col("max_length")).alias("length"))


@query(f"WITH {PROMPT_SQL} SELECT request_id, prompt FROM prompts")
def r11_render_prompt(spark, d):
    return t.requests(spark, d).select("request_id", P.render_prompt().alias("prompt"))


@query(f"""WITH {PROMPT_SQL} SELECT request_id, CASE template WHEN 'support' THEN 'Here are some examples of the expected output:' || chr(10) || chr(10) || 'Example 1:' || chr(10) || 'Input: product: ' || product || ', tone: polite' || chr(10) || 'Output: Could you help me with ' || product || '?' || chr(10) || 'Note: Polite' || chr(10) || chr(10)
    || 'Example 2:' || chr(10) || 'Input: product: ' || product || chr(10) || 'Output: ' || product || ' stopped.' || chr(10) || chr(10) || 'Now generate your own response following the same pattern:' || chr(10) || chr(10) || prompt
  WHEN 'review' THEN 'Here are some examples of the expected output:' || chr(10) || chr(10) || 'Example 1:' || chr(10) || 'Input: product: ' || product || chr(10) || 'Output: I like ' || product || '.' || chr(10) || chr(10) || 'Now generate your own response following the same pattern:' || chr(10) || chr(10) || prompt ELSE prompt END AS prompt FROM prompts""")
def r12_few_shot_block(spark, d):
    rows = t.requests(spark, d).withColumn("prompt", P.render_prompt())
    return P.few_shot_block(rows, t.examples(spark)).select("request_id", "prompt")


TURNS_SQL = "u AS (SELECT conv_id AS request_id, turn AS sample_index, text AS prompt FROM conversations WHERE role = 'user'), a AS (SELECT conv_id AS request_id, turn - 1 AS sample_index, text FROM conversations WHERE role = 'assistant')"


@query(f"WITH {TURNS_SQL} SELECT request_id, sample_index, trunc(len({t.w('a.text')}) * 1.3::DOUBLE)::INT AS tokens_estimated, false AS missing FROM u JOIN a USING (request_id, sample_index) UNION ALL SELECT request_id, sample_index, 0, true FROM u ANTI JOIN a USING (request_id, sample_index)")
def r13_assemble_samples(spark, d):
    made, missing = P.assemble_samples(*t.turns(spark, d), ["request_id", "sample_index"])
    return made.select("request_id", "sample_index", "tokens_estimated", F.lit(False).alias("missing")).unionByName(missing.select("request_id", "sample_index", F.lit(0).alias("tokens_estimated"), F.lit(True).alias("missing")))


@query(f"""WITH u AS (SELECT conv_id, turn, {CANNED_SQL}[(('0x' || left(md5(text || '0.7'), 8))::BIGINT % 5 + 1)::INT] AS full_text FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN array_to_string(string_split(full_text, ' ')[1:8], ' ') ELSE full_text END AS response FROM u""")
def r14_canned_response(spark, d):
    rows = t.table(spark, d, "conversations").where("role = 'user'")
    return P.generate(rows.select("conv_id", "turn", F.col("text").alias("prompt"), F.lit(0.7).alias("temperature"), F.when(F.col("turn") % 3 == 0, 8).alias("max_tokens"))).select("conv_id", "turn", F.col("text").alias("response"))


# Features and scores


@query(scored_sql("seq, word_count::INT AS word_count, char_count::INT AS char_count, sentence_count::INT AS sentence_count"))
def q1_text_counts(spark, d):
    return t.samples(spark, d).select("seq", *T.text_counts(F.col("text")))


@query(f"SELECT doc_id, {t.norm('text')} AS normal FROM documents")
def q2_normalize_text(spark, d):
    return t.table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, md5({t.norm('text')}) AS hash FROM documents")
def q3_text_hash(spark, d):
    return t.table(spark, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query(scored_sql("seq, length_score"))
def q4_length_score(spark, d):
    return t.samples(spark, d).select("seq", S.length_score(T.word_count(F.col("text"))).alias("length_score"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 0.7 WHEN quality = 1 THEN 0.9 ELSE 0.3 END::DOUBLE AS score FROM labels")
def q5_parse_score(spark, d):
    return t.coherence(spark, d).select(F.col("id").cast("long").alias("doc_id"), S.parse_score(F.col("response"), 0.7).alias("score"))


def scores_of(spark, d, *names):
    return S.score_samples(t.samples(spark, d), t.coherence(spark, d)).select("seq", *[r6(n) for n in names])


@query(scored_sql("seq, round(relevance_score, 6) AS relevance_score"))
def q6_relevance_score(spark, d):
    return scores_of(spark, d, "relevance_score")


@query(scored_sql("seq, round(grammar_score, 6) AS grammar_score"))
def q7_grammar_score(spark, d):
    return scores_of(spark, d, "grammar_score")


@query(scored_sql("seq, round(diversity_score, 6) AS diversity_score"))
def q8_diversity_score(spark, d):
    return scores_of(spark, d, "diversity_score")


@query(wins_sql(f"true AS eligible {FIT}", "seq, CASE reason WHEN 'exact_duplicate' THEN 0.0 WHEN 'semantic_similarity' THEN 0.5 ELSE 1.0 END::DOUBLE AS uniqueness_score"))
def q9_uniqueness_score(spark, d):
    return D.first_wins_dedup(Q.length_filter(t.samples(spark, d))).select("seq", S.uniqueness_score(F.col("reason")).alias("uniqueness_score"))


@query(scored_sql("seq, round(overall_score, 6) AS overall_score"))
def q10_overall_score(spark, d):
    return scores_of(spark, d, "overall_score")


ALL_SCORES = ("length_score", "coherence_score", "relevance_score", "grammar_score", "diversity_score", "overall_score")


@query(scored_sql("seq, " + ", ".join(f"round({n}, 6) AS {n}" for n in ALL_SCORES)))
def q11_score_samples(spark, d):
    return scores_of(spark, d, *ALL_SCORES)


# Duplicates and the filter


@query(f"WITH h AS (SELECT doc_id AS seq, md5({t.norm('text')}) AS text_hash FROM documents) SELECT seq, text_hash, row_number() OVER (PARTITION BY text_hash ORDER BY seq) > 1 AS is_duplicate FROM h")
def d1_exact_duplicates(spark, d):
    return D.exact_duplicates(t.samples(spark, d), []).select("seq", "text_hash", "is_duplicate")


SETS_SQL = f"sets AS MATERIALIZED (SELECT ws, min(doc_id) AS cid FROM (SELECT doc_id, {t.word_set('text')} AS ws FROM documents) GROUP BY ws), toks AS MATERIALIZED (SELECT cid, len(ws) AS m, unnest(ws) AS word FROM sets)"


@query(f"WITH {SETS_SQL} SELECT a.cid AS a, b.cid AS b, round(count(*)::DOUBLE / (a.m + b.m - count(*)), 6) AS similarity FROM toks a JOIN toks b ON a.word = b.word AND a.cid < b.cid AND least(a.m, b.m) >= 0.85::DOUBLE * greatest(a.m, b.m) GROUP BY a.cid, b.cid, a.m, b.m HAVING count(*)::DOUBLE / (a.m + b.m - count(*)) >= 0.85::DOUBLE")
def d2_near_duplicate_pairs(spark, d):
    return D.near_duplicate_pairs(t.samples(spark, d)).select("a", "b", r6("similarity"))


@query(f"WITH x AS (SELECT doc_id AS seq, {t.word_set('text')} AS ws FROM documents) SELECT seq, min(seq) OVER (PARTITION BY ws) AS class FROM x")
def d2_membership(spark, d):
    return D.word_set_members(t.samples(spark, d))


@query(wins_sql(f"true AS eligible {FIT}", "seq, reason"))
def d3_first_wins_dedup(spark, d):
    return D.first_wins_dedup(Q.length_filter(t.samples(spark, d))).select("seq", "reason")


@query(f"""WITH x AS MATERIALIZED (SELECT doc_id AS seq, md5({t.norm('text')}) AS h, {t.word_set('text')} AS ws FROM documents), k AS MATERIALIZED (SELECT seq, len(ws) AS m, unnest(ws) AS word FROM x),
  near AS (SELECT DISTINCT a.seq FROM k a JOIN k b ON a.word = b.word AND a.seq % 2 = 1 AND b.seq % 2 = 0 AND least(a.m, b.m) >= 0.85::DOUBLE * greatest(a.m, b.m) GROUP BY a.seq, b.seq, a.m, b.m HAVING count(*)::DOUBLE / (a.m + b.m - count(*)) >= 0.85::DOUBLE)
  SELECT seq, CASE WHEN h IN (SELECT h FROM x WHERE seq % 2 = 0) THEN 'exact_duplicate' WHEN seq IN (SELECT seq FROM near) THEN 'semantic_similarity' END AS reason FROM x WHERE seq % 2 = 1""")
def d4_dedup_against(spark, d):
    """Odd documents against even ones: the accepted table and the new one are both whole halves of documents."""
    rows = t.samples(spark, d)
    return C.dedup_against(rows.where("seq % 2 = 1"), rows.where("seq % 2 = 0")).select("seq", "reason")


@query(f"SELECT count(DISTINCT md5({t.norm('text')})) AS total_seen, count(DISTINCT {t.norm('text')}) AS unique_normalized FROM documents")
def d5_dedup_stats(spark, d):
    return D.dedup_stats(t.samples(spark, d))


@query(samples_sql("seq", "WHERE word_count BETWEEN 10 AND 500"))
def f1_length_filter(spark, d):
    return Q.length_filter(t.samples(spark, d)).select("seq")


def labelled(spark, d):
    return Q.quality_filter(t.samples(spark, d), coherence=t.coherence(spark, d))


@query(LABELLED + "SELECT seq, status, reason, round(overall_score, 6) AS overall_score FROM labelled")
def f2_quality_filter(spark, d):
    return labelled(spark, d).select("seq", "status", "reason", r6("overall_score"))


@query(LABELLED + """SELECT job_id, count(*) AS total_processed, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed_length') AS failed_length, count(*) FILTER (status = 'failed_quality') AS failed_quality, count(*) FILTER (status = 'failed_duplicate') AS failed_duplicate,
  round(count(*) FILTER (status = 'passed')::DOUBLE / count(*), 6) AS pass_rate, round(count(*) FILTER (status = 'failed_duplicate')::DOUBLE / count(*), 6) AS duplicate_rate FROM labelled GROUP BY job_id""")
def f3_filter_stats(spark, d):
    return Q.filter_stats(labelled(spark, d), ["job_id"]).select("job_id", "total_processed", *Q.STATUSES, r6("pass_rate"), r6("duplicate_rate"))


@query(LABELLED + """SELECT job_id, count(*) AS original_count, count(*) FILTER (status = 'passed') AS filtered_count, round(avg(overall_score) FILTER (status = 'passed'), 6) AS avg_overall, coalesce(sum(tokens_estimated) FILTER (status = 'passed'), 0)::BIGINT AS tokens,
  CASE WHEN count(*) FILTER (status = 'passed') <= 40 THEN coalesce(string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (status = 'passed'), '') ELSE '' END AS listed FROM labelled GROUP BY job_id""")
def f4_batch_summary(spark, d):
    rows = Q.batch_summary(labelled(spark, d), ["job_id"], most_listed=40)
    return rows.select("job_id", "original_count", "filtered_count", r6("avg_overall"), "tokens", F.array_join(F.col("metrics.seq").cast("array<string>"), ",").alias("listed"))


# Augmentation

ASPECTS_SQL = f"list_sort(list_distinct(list_concat(list_filter({t.LEXICON}, lambda a: contains(lower(text), a)), list_filter(regexp_extract_all(lower(text), '{T.WORD}'), lambda x: x IN ('app','software','device','product','service','system','platform')))))"


#: The whole list as text, and some words of the invented prose of which one begins with another.
ALL_TERMS = "['quality', 'price', 'cost', 'value', 'design', 'appearance', 'performance', 'speed', 'reliability', 'durability', 'features', 'functionality', 'usability', 'interface', 'battery', 'display', 'size', 'weight', 'color', 'style', 'brand', 'packaging', 'service', 'support', 'help', 'assistance', 'response', 'delivery', 'shipping', 'installation', 'setup', 'training', 'documentation', 'warranty', 'guarantee', 'refund', 'return', 'exchange', 'experience', 'satisfaction', 'convenience', 'ease', 'simplicity', 'comfort', 'safety', 'security', 'privacy', 'trust', 'confidence', 'the', 'then', 'on', 'and']"


@query(f"SELECT doc_id AS seq, array_to_string({ASPECTS_SQL.replace(str(t.LEXICON), ALL_TERMS)}, ',') AS aspects FROM documents")
def a1_extract_aspects(spark, d):
    return t.samples(spark, d).select("seq", F.array_join(A.extract_aspects(F.col("text"), [*A.ASPECTS, "the", "then", "on", "and"], proper=False), ",").alias("aspects"))


ORIGINALS_SQL = f"{t.SAMPLES_SQL}, o AS MATERIALIZED (SELECT *, id AS sample_id, {ASPECTS_SQL} AS aspects, {t.w('text')} AS ws FROM samples)"
CDA_SQL = f"""{ORIGINALS_SQL}, cand AS (SELECT o.*, 0 AS variant_index, array_to_string(ws[1:len(ws) - 1], ' ') AS variant FROM o UNION ALL SELECT o.*, 1, 'new ' || array_to_string(ws, ' ') FROM o WHERE seq % 2 = 0),
pres AS MATERIALIZED (SELECT *, CASE WHEN len(aspects) = 0 THEN 1 ELSE len(list_filter(aspects, lambda a: contains(lower(variant), a)))::DOUBLE / len(aspects) END AS preserved, CASE WHEN seq % 5 = 0 THEN 0.5 WHEN seq % 2 = 0 THEN 0.95 ELSE 0.7 END::DOUBLE AS sim FROM cand),
val AS MATERIALIZED (SELECT *, (preserved + sim) / 2 AS score, list_sort(list_distinct({t.w('lower(variant)')})) AS vw, list_sort(list_distinct({t.w('lower(text)')})) AS tw FROM pres), cda AS MATERIALIZED (SELECT * FROM val WHERE variant <> '' AND variant <> text AND score >= 0.8::DOUBLE)"""


def paraphrases(spark, d):
    return t.originals(spark, d).join(t.variants(spark, d).select("sample_id", "strategy", "variant_index", A.unwrapped(F.col("text")).alias("variant")), "sample_id").withColumn("aspects", A.extract_aspects(F.col("text"), t.LEXICON, proper=False))


@query(f"WITH {CDA_SQL} SELECT sample_id, variant_index, round(preserved, 6) AS preservation FROM val")
def a2_aspect_preservation(spark, d):
    return paraphrases(spark, d).select("sample_id", "variant_index", F.round(A.aspect_preservation(F.col("aspects"), F.col("variant")), 6).alias("preservation"))


@query(f"WITH {CDA_SQL} SELECT sample_id, variant_index, round(score, 6) AS score, score >= 0.8::DOUBLE AS is_valid FROM val")
def a3_validate_variants(spark, d):
    return A.validate_variants(paraphrases(spark, d), t.similarity(spark, d)).select("sample_id", "variant_index", r6("score"), "is_valid")


@query(f"WITH {CDA_SQL} SELECT sample_id, variant_index FROM cda WHERE score >= 0.85::DOUBLE")
def a4_accept_variants(spark, d):
    return A.accept_variants(A.validate_variants(paraphrases(spark, d), t.similarity(spark, d)), 0.85).select("sample_id", "variant_index")


CHANGES_SQL = "list_concat(list_transform(list_filter(vw, lambda y: NOT list_contains(tw, y) AND NOT list_contains(aspects, y)), lambda y: 'added: ' || y), list_transform(list_filter(tw, lambda y: NOT list_contains(vw, y) AND NOT list_contains(aspects, y)), lambda y: 'removed: ' || y))"


@query(f"WITH {CDA_SQL} SELECT sample_id, variant_index, array_to_string({CHANGES_SQL}, '|') AS changes FROM val")
def a5_identify_changes(spark, d):
    return paraphrases(spark, d).select("sample_id", "variant_index", F.array_join(A.identify_changes(F.col("text"), F.col("variant"), F.col("aspects")), "|").alias("changes"))


#: A word's neighbours are looked at by hand, as this engine has no look-around: twice, for occurrences that share a blank.
def replaced_sql(text: str, old: str, new: str) -> str:
    once = lambda x: f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || {old} || '($|[^\\p{{L}}\\p{{N}}_])', '\\1' || {new} || '\\2', 'g')"
    return once(once(text))


@query(f"SELECT doc_id AS seq, {replaced_sql('text', repr('the'), repr('$1 x'))} AS text FROM documents")
def a6_replace_aspect(spark, d):
    return t.samples(spark, d).select("seq", A.replace_aspect(F.col("text"), F.lit("the"), F.lit("$1 x")).alias("text"))


ALT_SQL = "alts AS (SELECT * FROM (VALUES ('the', NULL, ['these', 'those']), ('the', 'src8', ['this']), ('and', NULL, ['plus']), ('and', 'src9', ['also', 'plus']), ('thon', NULL, ['thing']), ('que', NULL, ['qui']), ('der', 'src8', ['dem'])) v(aspect, product, choices))"
ADA_SQL = f"""{CDA_SQL}, {ALT_SQL}, turn AS (SELECT o.*, i::INT AS variant_index, aspects[(i % len(aspects) + 1)::INT] AS aspect, i // len(aspects) AS round FROM o, range(0, 3) r(i) WHERE len(aspects) > 0),
offered AS (SELECT turn.*, coalesce(own.choices, every.choices) AS choices FROM turn LEFT JOIN alts own ON own.aspect = turn.aspect AND own.product = turn.product LEFT JOIN alts every ON every.aspect = turn.aspect AND every.product IS NULL),
chosen_ AS (SELECT *, choices[(round % len(choices) + 1)::INT] AS alternative FROM offered WHERE choices IS NOT NULL),
repl AS MATERIALIZED (SELECT *, {replaced_sql('text', 'aspect', 'alternative')} AS variant, list_filter(aspects, lambda x: x <> aspect) AS others FROM chosen_),
ada AS MATERIALIZED (SELECT *, (CASE WHEN len(others) = 0 THEN 1 ELSE len(list_filter(others, lambda a: contains(lower(variant), a)))::DOUBLE / len(others) END + CASE WHEN seq % 5 = 0 THEN 0.5 WHEN seq % 2 = 0 THEN 0.95 ELSE 0.7 END::DOUBLE) / 2 AS score FROM repl WHERE variant <> text)"""


def ada(spark, d, n=3):
    return A.ada_variants(t.originals(spark, d), t.alternatives(spark), t.similarity(spark, d), n, t.LEXICON, proper=False)


def cda(spark, d):
    return A.cda_variants(t.originals(spark, d), t.variants(spark, d), t.similarity(spark, d), t.LEXICON, proper=False)


@query(f"WITH {ADA_SQL} SELECT sample_id, variant_index, variant, round(score, 6) AS score, 'replaced ''' || aspect || ''' with ''' || alternative || '''' AS change FROM ada WHERE score >= 0.8::DOUBLE")
def a7_ada_variants(spark, d):
    return ada(spark, d).select("sample_id", "variant_index", "variant", r6("score"), F.element_at("changes", 1).alias("change"))


@query(f"WITH {CDA_SQL} SELECT sample_id, variant_index, variant, round(score, 6) AS score, array_to_string({CHANGES_SQL}, '|') AS changes FROM cda")
def a8_cda_variants(spark, d):
    return cda(spark, d).select("sample_id", "variant_index", "variant", r6("score"), F.array_join("changes", "|").alias("changes"))


@query("SELECT p_partkey AS request_id, greatest(1, p_size // 2)::BIGINT AS cda, (p_size - greatest(1, p_size // 2))::BIGINT AS ada, CASE WHEN p_size > 3 THEN least(2, p_size // 3) ELSE 0 END::BIGINT AS combined FROM part")
def a9_cada_plan(spark, d):
    cols = A.cada_plan(F.col("count").cast("long"))
    return t.requests(spark, d).select("request_id", *cols).select("request_id", *[F.col(c).cast("long") for c in ("cda", "ada", "combined")])


@query(f"""WITH {ADA_SQL}, both_ AS (SELECT c.sample_id, c.variant_index, c.variant, c.score, c.va[1] AS aspect, coalesce(own.choices, every.choices)[1] AS alternative FROM (SELECT *, {ASPECTS_SQL.replace('text', 'variant')} AS va FROM cda WHERE variant_index < 1) c
  LEFT JOIN alts own ON own.aspect = c.va[1] AND own.product = c.product LEFT JOIN alts every ON every.aspect = c.va[1] AND every.product IS NULL WHERE coalesce(own.choices, every.choices) IS NOT NULL)
  SELECT sample_id, 'CDA' AS kind, variant_index, variant, round(score, 6) AS score FROM cda WHERE variant_index < 2 UNION ALL SELECT sample_id, 'ADA', variant_index, variant, round(score, 6) FROM ada WHERE score >= 0.8::DOUBLE AND variant_index < 2
  UNION ALL SELECT sample_id, 'COMBINED', variant_index, {replaced_sql('variant', 'aspect', 'alternative')}, round(score, 6) FROM both_ WHERE {replaced_sql('variant', 'aspect', 'alternative')} <> variant""")
def a10_cada_variants(spark, d):
    return A.cada_variants(t.originals(spark, d), t.variants(spark, d), t.alternatives(spark), t.similarity(spark, d), 4, t.LEXICON, proper=False).select("sample_id", "kind", "variant_index", "variant", r6("score"))


SELECTED_SQL = "(SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM {src}) WHERE r <= least(n, greatest(1, floor(n * 0.3::DOUBLE)))"


@query(samples_sql("seq, job_id", "").replace("FROM samples ", "FROM " + SELECTED_SQL.format(src="samples")))
def a11_select_for_augmentation(spark, d):
    return A.select_for_augmentation(t.samples(spark, d), 0.3, ["job_id"]).select("seq", "job_id")


@query(f"WITH {CDA_SQL} SELECT md5(sample_id || '|CDA|' || variant_index) AS id, sample_id, 'v1_aug_CDA' AS prompt_version, trunc(len({t.w('variant')}) * 1.3::DOUBLE)::INT AS tokens_estimated, round(score, 6) AS quality_score FROM cda")
def a12_build_augmented_samples(spark, d):
    rows = A.build_augmented_samples(cda(spark, d), t.originals(spark, d))
    return rows.select("id", F.col("metadata.original_sample_id").alias("sample_id"), "prompt_version", "tokens_estimated", F.round("metadata.quality_score", 6).alias("quality_score"))


@query(f"""WITH {ADA_SQL}, chosen AS (SELECT sample_id AS s FROM {SELECTED_SQL.format(src='o')}), made AS (SELECT sample_id, 'CDA' AS k, variant_index, variant FROM cda WHERE variant_index < 2 UNION ALL SELECT sample_id, 'ADA', variant_index, variant FROM ada WHERE score >= 0.8::DOUBLE AND variant_index < 2)
  SELECT sample_id AS id, prompt_version, tokens_estimated FROM o UNION ALL SELECT md5(sample_id || '|' || k || '|' || variant_index), 'v1_aug_' || k, trunc(len({t.w('variant')}) * 1.3::DOUBLE)::INT FROM made WHERE sample_id IN (SELECT s FROM chosen)""")
def a13_augment_dataset(spark, d):
    return A.augment_dataset(t.originals(spark, d), t.variants(spark, d), t.alternatives(spark), t.similarity(spark, d), ["CDA", "ADA", "NONE"], 0.3, ["job_id"], 2, t.LEXICON, proper=False).select("id", "prompt_version", "tokens_estimated")


@query(f"""WITH {ADA_SQL}, made AS (SELECT sample_id, 'CDA' AS strategy, variant_index, variant, score, NULL AS gone, {CHANGES_SQL} AS ch FROM cda UNION ALL SELECT sample_id, 'ADA', variant_index, variant, score, aspect, ['replaced ''' || aspect || ''' with ''' || alternative || ''''] FROM ada WHERE score >= 0.8::DOUBLE),
  sums AS (SELECT sample_id, strategy, string_agg(variant, '|' ORDER BY variant_index) AS texts, list(gone) AS gone, list_sort(list_distinct(flatten(list(ch)))) AS changed, count(*) AS n, avg(score) AS mean, max(score) AS top FROM made GROUP BY ALL), sk AS (SELECT sample_id, aspects, unnest(['CDA', 'ADA']) AS strategy FROM o)
  SELECT sk.sample_id, sk.strategy, coalesce(texts, '') AS texts, round(coalesce(top, 0), 6) AS best_score, array_to_string(list_filter(aspects, lambda x: NOT coalesce(list_contains(gone, x), false)), '|') AS preserved, coalesce(array_to_string(changed, '|'), '') AS changed, 3 AS requested, coalesce(n, 0) AS successful, round(coalesce(mean, 0), 6) AS avg_score FROM sk LEFT JOIN sums USING (sample_id, strategy)""")
def a14_augmentation_summary(spark, d):
    rows = A.augmentation_summary(t.originals(spark, d), cda(spark, d).unionByName(ada(spark, d)), ["CDA", "ADA"], 3, t.LEXICON, proper=False)
    listed = lambda c: F.array_join(c, "|").alias(c)
    best = F.round(F.coalesce(F.array_max("scores"), F.lit(0.0)), 6).alias("best_score")
    return rows.select("sample_id", "strategy", listed("texts"), best, listed("preserved"), listed("changed"), "requested", "successful", r6("avg_score"))


# Request log

TRAIL_SQL = "count(*) OVER f AS requests_in_window, sum(tokens) OVER f AS tokens_in_window"
FRAME_SQL = "WINDOW f AS (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)"


@query(f"WITH {t.LOG_SQL} SELECT event_id, requests_in_window, round(tokens_in_window, 6) AS tokens_in_window FROM (SELECT event_id, {TRAIL_SQL} FROM log {FRAME_SQL})")
def u1_trailing_usage(spark, d):
    return U.trailing_usage(t.request_log(spark, d), 3600).select("event_id", "requests_in_window", r6("tokens_in_window"))


@query(f"WITH {t.LOG_SQL} SELECT key, count(*) AS requests, round(sum(tokens), 6) AS tokens, round(count(*)::DOUBLE / 100 * 100, 6) AS request_pct, round(sum(tokens) / 5000 * 100, 6) AS token_pct, greatest(0, 100 - count(*))::BIGINT AS requests_remaining, round(greatest(0, 5000 - sum(tokens)), 6) AS tokens_remaining FROM log WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 86400 SECOND AND ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY key")
def u2_usage_report(spark, d):
    rows = U.usage_report(t.request_log(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"), 100, 5000, 86400)
    return rows.select("key", "requests", r6("tokens"), r6("request_pct"), r6("token_pct"), F.col("requests_remaining").cast("long").alias("requests_remaining"), r6("tokens_remaining"))


WAIT_SQL = "CASE ({n}) % 6 WHEN 0 THEN 360 WHEN 1 THEN 1 WHEN 2 THEN 120 WHEN 3 THEN 3600 WHEN 4 THEN 0 ELSE 30000 END::BIGINT"


@query(f"SELECT event_id, {WAIT_SQL.format(n='event_id')} AS seconds FROM events")
def u3_parse_reset_duration(spark, d):
    return t.limit_headers(spark, d).select("event_id", U.parse_reset_duration(F.element_at("headers", "x-ratelimit-reset-requests")).alias("seconds"))


HEAD_SQL = f"""h AS (SELECT event_id, ts, (props->>'$.k')::BIGINT AS k, floor(value)::BIGINT AS v, event_id % 11 <> 0 AS whole, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 40000 END AS tl, {WAIT_SQL.format(n='event_id')} AS wait FROM events)"""


@query(f"WITH {HEAD_SQL} SELECT event_id, CASE WHEN whole THEN 100 ELSE -1 END::BIGINT AS request_limit, CASE WHEN whole THEN k ELSE -1 END AS requests_left, CASE WHEN whole THEN epoch_us(ts + to_seconds(wait)) ELSE -1 END AS reset_us, CASE WHEN whole THEN round((100 - k)::DOUBLE / 100 * 100, 6) END AS usage_pct, CASE WHEN whole AND tl > 0 THEN v ELSE -1 END AS tokens_left FROM h")
def u4_parse_limit_headers(spark, d):
    rows = U.parse_limit_headers(t.limit_headers(spark, d))
    none = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    return rows.select("event_id", none(F.col("request_info.limit")).alias("request_limit"), none(F.col("request_info.remaining")).alias("requests_left"), none(F.unix_micros("request_info.reset_time")).alias("reset_us"), F.round("request_info.usage_pct", 6).alias("usage_pct"), none(F.col("token_info.remaining")).alias("tokens_left"))


@query(f"WITH {HEAD_SQL} SELECT event_id, CASE WHEN k <= 0 THEN 'request limit exhausted' WHEN v < 20 THEN 'not enough tokens remaining' END AS blocked, 100 - k >= 90 AS near FROM h WHERE whole AND tl > 0")
def u5_proactive_check(spark, d):
    rows = U.parse_limit_headers(t.limit_headers(spark, d)).where("request_info is not null and token_info is not null")
    return rows.select("event_id", U.proactive_check(F.col("request_info.remaining"), F.col("token_info.remaining"), F.lit(20)).alias("blocked"), U.near_limit(F.col("request_info.usage_pct")).alias("near"))


ORDERED_SQL = f"{t.LOG_SQL}, o AS MATERIALIZED (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM log)"
BUCKET_SQL = """b(key, rn, event_id, us, r, k, ok1, ok2) AS (SELECT key, rn, event_id, us, 5::DOUBLE - 1, 60::DOUBLE - CASE WHEN tokens <= 60 THEN tokens ELSE 0 END, true, tokens <= 60 FROM o WHERE rn = 1 UNION ALL
  SELECT o.key, o.rn, o.event_id, o.us, n.r2 - CASE WHEN n.r2 >= 1 THEN 1 ELSE 0 END, n.k2 - CASE WHEN n.k2 >= o.tokens THEN o.tokens ELSE 0 END, n.r2 >= 1, n.k2 >= o.tokens
  FROM b JOIN o ON o.key = b.key AND o.rn = b.rn + 1, LATERAL (SELECT least(5::DOUBLE, b.r + (o.us - b.us)::DOUBLE / 1000000 * 0.002::DOUBLE) AS r2, least(60::DOUBLE, b.k + (o.us - b.us)::DOUBLE / 1000000 * 0.01::DOUBLE) AS k2) n)"""


@query(f"WITH RECURSIVE {ORDERED_SQL}, {BUCKET_SQL} SELECT event_id, ok1 AND ok2 AS admitted, round(r, 6) AS request_level, round(k, 6) AS token_level FROM b")
def u6_token_bucket(spark, d):
    return B.token_bucket(t.request_log(spark, d), 5.0, 0.002, 60.0, 0.01).select("event_id", "admitted", r6("request_level"), r6("token_level"))


@query(f"WITH {t.LOG_SQL} SELECT key, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (rate_limited) AS rate_limited, count(*) FILTER (rate_limited AND attempt < 6) AS retried, round(count(*) FILTER (ok) * 100.0 / count(*), 6)::DOUBLE AS success_pct, max(requests_in_window) AS peak_requests, round(max(tokens_in_window), 6) AS peak_tokens FROM (SELECT *, {TRAIL_SQL} FROM log {FRAME_SQL}) GROUP BY key")
def u7_usage_metrics(spark, d):
    return U.usage_metrics(t.request_log(spark, d), ["key"], 3600).select("key", "total", "successful", "rate_limited", "retried", F.round(F.col("success_pct").cast("double"), 6).alias("success_pct"), "peak_requests", r6("peak_tokens"))


@query(f"WITH RECURSIVE {ORDERED_SQL}, e(key, rn, event_id, ema) AS (SELECT key, rn, event_id, latency FROM o WHERE rn = 1 UNION ALL SELECT o.key, o.rn, o.event_id, CASE WHEN e.ema = 0 THEN o.latency ELSE 0.1::DOUBLE * o.latency + (1 - 0.1::DOUBLE) * e.ema END FROM e JOIN o ON o.key = e.key AND o.rn = e.rn + 1) SELECT event_id, round(ema, 6) AS ema FROM e")
def u8_ema_response_time(spark, d):
    return U.ema_response_time(t.request_log(spark, d)).select("event_id", r6("ema"))


@query("SELECT event_id, CASE WHEN event_id % 12 - 2 <= 0 THEN 0 ELSE least(pow(2, event_id % 12 - 3), 60) END::DOUBLE AS delay FROM events")
def u9_backoff_delay(spark, d):
    return t.table(spark, d, "events").select("event_id", R.backoff_delay(F.col("event_id") % 12 - 2).alias("delay"))


@query(f"WITH RECURSIVE {ORDERED_SQL}, p(key, rn, event_id, batch_id, n, s) AS (SELECT key, rn, event_id, 0::BIGINT, 1, tokens FROM o WHERE rn = 1 UNION ALL SELECT o.key, o.rn, o.event_id, CASE WHEN p.n >= 10 OR p.s >= 100 THEN p.batch_id + 1 ELSE p.batch_id END, CASE WHEN p.n >= 10 OR p.s >= 100 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n >= 10 OR p.s >= 100 THEN o.tokens ELSE p.s + o.tokens END FROM p JOIN o ON o.key = p.key AND o.rn = p.rn + 1) SELECT event_id, batch_id FROM p")
def u10_pack_batches(spark, d):
    return K.pack_batches(t.request_log(spark, d), 10, 100).select("event_id", "batch_id")


# Job log

JOBS_SQL = "j AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'STARTED' WHEN 'click' THEN 'PROGRESS' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' END AS state, 'w' || event_id % 7 AS worker, CASE WHEN event_id % 2 = 0 THEN props END AS error, CASE WHEN event_type IN ('purchase', 'error') AND event_id % 3 <> 0 THEN ts - INTERVAL 1 SECOND END AS completed_at FROM events), last AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)"
LATEST_SQL = f"{JOBS_SQL}, s AS (SELECT l.job_id, l.state, CASE l.state WHEN 'PENDING' THEN 'pending' WHEN 'STARTED' THEN 'running' WHEN 'PROGRESS' THEN 'running' WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILURE' THEN 'error' ELSE 'unknown' END AS status, coalesce(l.completed_at, l.ts) AS ts, l.error FROM last l)"


@query(f"WITH {LATEST_SQL} SELECT job_id, state, status, epoch_us(ts) AS updated_us, CASE WHEN status = 'error' THEN coalesce(error, 'Task failed with unknown error') END AS error FROM s")
def j1_latest_job_status(spark, d):
    return J.latest_job_status(t.job_events(spark, d), ["ts", "event_id"]).select("job_id", "state", "status", F.unix_micros("updated_at").alias("updated_us"), "error")


@query(f"WITH {JOBS_SQL} SELECT count(*) FILTER (state IN ('STARTED', 'PROGRESS')) AS active, count(*) FILTER (state = 'RETRY') AS scheduled, count(*) FILTER (state = 'PENDING') AS reserved, count(*) FILTER (state IN ('STARTED', 'PROGRESS', 'RETRY', 'PENDING')) AS total, (SELECT count(DISTINCT worker) FROM j) AS workers FROM last")
def j2_job_stats(spark, d):
    return J.job_stats(t.job_events(spark, d), ["ts", "event_id"])


@query("SELECT p_partkey AS request_id, trunc(least(p_partkey % 60, p_size)::DOUBLE / p_size * 100)::INT AS progress FROM part")
def j3_progress_pct(spark, d):
    return t.requests(spark, d).select("request_id", R.progress_pct(F.least(F.col("request_id") % 60, F.col("count").cast("long")), F.col("count")).alias("progress"))


@query(f"WITH {LATEST_SQL} SELECT job_id FROM s WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7200 SECOND")
def j4_expire_results(spark, d):
    return J.expire_results(J.latest_job_status(t.job_events(spark, d), ["ts", "event_id"]), F.lit("2024-01-30 12:00:00").cast("timestamp")).select("job_id")


# Streams


#: Streams get their table in so many parts, one after another, each by a run of its own from the checkpoint of the one before.
PARTS = 3
#: The third of its time span that an event belongs to, 0 to 2; every 50th event of the first third comes with the last: too late.
PART_SQL = "least(2, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE * 3 / ((SELECT max(epoch_us(ts)) FROM events) - (SELECT min(epoch_us(ts)) FROM events))))"


def events_parts(spark, d):
    """The request log with ``part``, its third of the time span."""
    rows = t.request_log(spark, d).select("event_id", "key", "ts", "tokens")
    us = F.unix_micros("ts")
    span = rows.agg(F.min(us).alias("low"), F.max(us).alias("high"))
    return rows.join(F.broadcast(span)).withColumn("part", F.least(F.lit(2), F.floor((us - F.col("low")).cast("double") * PARTS / (F.col("high") - F.col("low"))))).drop("low", "high")


def in_parts(spark, rows, run):
    """``run(stream of rows, number)`` once more for each part, when the part's rows have been added to the stream's folder."""
    folder, columns = scratch_path(spark, "source"), [c for c in rows.columns if c != "part"]
    for k in range(PARTS):
        rows.where(F.col("part") == k).select(*columns).write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.select(*columns).schema).parquet(folder), k)


def drained(spark, rows, transform, mode):
    """(columns of the stream's result, batch) of all micro-batches; each overwrites its own folder."""
    out = scratch_path(spark, "stream")
    schema = []

    def run(stream, k):
        made = transform(stream)
        schema[:] = [made.schema]
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        made.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    in_parts(spark, rows, run)
    return spark.read.schema(schema[0].add("batch", "long")).option("basePath", out).parquet(f"{out}/batch=*")


@query(f"""WITH p AS (SELECT *, {PART_SQL} AS part FROM events), log AS (SELECT ts, event_type AS key, value::DOUBLE AS tokens FROM p WHERE NOT (part = 0 AND event_id % 50 = 0))
  SELECT epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS start_us, key, count(*) AS requests, round(sum(tokens), 6) AS tokens FROM log GROUP BY 1, 2""")
def t1_stream_usage(spark, d):
    """What comes too late is dropped; of each window, the last update counts."""
    rows = events_parts(spark, d).withColumn("part", F.when((F.col("part") == 0) & (F.col("event_id") % 50 == 0), 2).otherwise(F.col("part")))
    made = drained(spark, rows, X.stream_usage, "update").groupBy("start", "key").agg(F.max_by(F.struct("requests", "tokens"), "batch").alias("x"))
    return made.select(F.unix_micros("start").alias("start_us"), "key", "x.requests", F.round("x.tokens", 6).alias("tokens"))


@query(f"WITH RECURSIVE {ORDERED_SQL}, {BUCKET_SQL} SELECT event_id, ok1 AND ok2 AS admitted, round(r, 6) AS request_level, round(k, 6) AS token_level FROM b")
def t2_stream_token_bucket(spark, d):
    made = drained(spark, events_parts(spark, d), lambda log: X.stream_token_bucket(log, 5.0, 0.002, 60.0, 0.01), "append")
    return made.select("event_id", "admitted", r6("request_level"), r6("token_level"))


@query(f"""WITH RECURSIVE {t.SCORED_SQL.replace("CASE WHEN toxic = 1 THEN 0.7 WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.3 ELSE 0.7 END::DOUBLE", "0.7::DOUBLE")}, src AS (SELECT seq, text, overall_score >= 0.6::DOUBLE AS eligible {FIT}), {t.first_wins_sql('src')}
  SELECT s.seq FROM scored s JOIN reasons r ON r.seq = s.seq WHERE r.reason IS NULL AND overall_score >= 0.6::DOUBLE""")
def t3_stream_quality_filter(spark, d):
    """Parts in the order of seq: each is held against what the parts before it left accepted."""
    rows = t.samples(spark, d).select("seq", "text", "product", "template_type")
    ends = rows.approxQuantile("seq", [k / PARTS for k in range(1, PARTS)], 0.01)
    out = scratch_path(spark, "accepted")
    in_parts(spark, rows.withColumn("part", sum((F.col("seq") > F.lit(x)).cast("int") for x in ends) if ends else F.lit(0)), lambda stream, k: X.stream_quality_filter(stream, out, f"{out}-state").awaitTermination())
    return spark.read.parquet(out).select("seq")
