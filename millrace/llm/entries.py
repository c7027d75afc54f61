"""The thin queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, counts, langid, lm, mixing, negatives, simhash, suffixes, tokenfiles, toxicity, vafile
from .common import remainder, scratch_path, spread, written

PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 4) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 3) == 1
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, WORD_BPE, decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES_32K).select("doc_id", "n_tokens")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 7) == 2
    model, words = lm.train(docs.where(~held))
    found = lm.score(docs, model, words, keep=(held.alias("held_out"),))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.compress(_table(spark, sf_dir, "embeddings"))
    # The sums of errors and their rows come from one written table, not from two runs of the last assignment.
    summed = codes.with_label_error(written(coded, "coded"))
    return summed.select("vec_id", codes.hex_codes().alias("code"), "error", "label_error", F.lit(codes.digest(book)).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenfiles.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, end=2, binary=True)
    folder = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(docs, folder)
    return tokenfiles.read_tokens(spark, folder, binary=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_ann, op2_toxicity, op3_suffix_dedup, op4_vafile, op5_langid, op6_bpe, op7_simhash, op8_token_counts, op9_lm_scoring, op10_mixing, op11_vector_codes, op12_hard_negatives, op13_token_files)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Exact search over all pairs of a query and a row; only whole numbers are compared.
OP4_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


#: All anchors against all rows, and all positives' windows against all rows of their anchors.
OP12_SQL = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM ok a JOIN ok c ON a.vec_id <> c.vec_id AND a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def op11_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Every round assigns all parts to all entries; components are rows (vec_id, part, place, x), codebooks rows (part, entry, place, c)."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT vec_id, p, e, dist FROM (SELECT x.vec_id, x.p, b.e, sum((x.x - b.c) * (x.x - b.c))::BIGINT AS dist FROM comps x JOIN b{r} b ON b.p = x.p AND b.d = x.d GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, e) = 1
)"""
    moved = """b{n} AS MATERIALIZED (
  SELECT b.p, b.e, b.d, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT a.p, a.e, x.d, floor(sum(x.x)::DOUBLE / count(*))::BIGINT AS c FROM a{r} a JOIN comps x ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL
  ) m ON m.p = b.p AND m.e = b.e AND m.d = b.d
)"""
    steps = [f(**{"r": r, "n": r + 1}) for r in range(rounds) for f in (nearest.format, moved.format)] + [nearest.format(r=rounds)]
    return f"""
WITH ok AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comps AS MATERIALIZED (
  SELECT vec_id, (i - 1) // width AS p, (i - 1) % width AS d, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ok)
), b0 AS MATERIALIZED (
  SELECT p, e, d, x AS c FROM comps JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM ok ORDER BY vec_id LIMIT {entries}) USING (vec_id)
), {", ".join(steps)}, done AS MATERIALIZED (
  SELECT vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, d)) FROM b{rounds}) AS codebooks_sha256
FROM done JOIN ok USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op4_vafile": OP4_SQL, "op11_vector_codes": op11_sql(), "op12_hard_negatives": OP12_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
