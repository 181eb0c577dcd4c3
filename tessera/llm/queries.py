"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, mixing, quality, repetition, secret_scan, shards, simhash, tokens, toxicity
from tessera.llm.common import bound_batches, read

#: The tokenizer that op7 and the pipeline's last stage use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.document_shards(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.read_back(chat.chat_examples(turns.unionByName(extra)))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mixing.mix(read(spark, sf_dir, "documents"))
    made = mixing.taken(rows, plan)
    return made.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_decontaminate, op3_shards, op4_chat, op5_secrets, op6_toxicity, op7_tokens, op8_simhash, op9_mixing, op10_repetition, pipeline)
    return {f.__name__: _in_bounded_batches(f) for f in own}


def _in_bounded_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


#: Chat formatting: lengths and digests follow from the turns.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of,
    sum(3 + length(url_encode(role)) + 1 + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + 4) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR n = of) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

#: Mixing: the level at which targets stand still, then the rows by hash up to each source's rest, counted off where they are equal.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER o AS k,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source)
), l AS (
  SELECT level FROM r WHERE 2.0::DOUBLE * source_size > level * w ORDER BY k LIMIT 1
), g AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM l) * w) AS target FROM s
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM g
), c AS (
  SELECT d.*, source_size, target, copies, target - copies * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS words, count(*) OVER (PARTITION BY d.source, h) AS n,
    row_number() OVER (PARTITION BY d.source, h ORDER BY doc_id, size) AS nth
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN rest > 0 AND (upto < rest OR (upto - words < rest AND nth <= floor((2 * (rest - (upto - words)) * n + words) / (2 * words)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; the other operators rest on models, xxHash, tokenizers or random draws, and are tested by brute force."""
    return {"op4_chat": OP4_SQL, "op9_mixing": OP9_SQL}
