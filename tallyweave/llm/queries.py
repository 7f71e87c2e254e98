"""The ten operators as queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_blocks, jaccard_join, line_dedup, secrets, substring_dedup, token_store, topk_codes, toxicity
from .runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk_codes.sign_code("embedding", 64).alias("code"))
    found = topk_codes.top_k(rows, rows.where("id % 50 = 0"), k=10, bits=64)
    return found.select(F.col("query_id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.col("neighbor_id"), F.col("distance").cast("bigint").alias("distance"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), bpe_pattern())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_topk_codes, op2_substring_dedup, op3_toxicity, op4_byte_bpe, op5_line_dedup, op6_decontaminate, op7_html_text, op8_secret_scan, op9_jaccard_join, op10_token_store)}

ORACLE_SQL = {
    "op1_topk_codes": """
WITH c AS (
  SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN coalesce(embedding[i], 0) > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE vec_id IS NOT NULL
), d AS (
  SELECT q.vec_id, r.vec_id AS neighbor_id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.bits[i] - r.bits[i]))) AS BIGINT) AS distance
  FROM c q, c r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, rank, neighbor_id, distance FROM k WHERE rank <= 10
""",
    "op5_line_dedup": """
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM p),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, pos, line, owner IS NOT NULL AND owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
}
