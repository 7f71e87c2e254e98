"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared scratch folder and rereads it as the next one's docs, so each stage begins by deleting the scratch tables
of those before it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tallyweave.llm.queries import bpe_pattern, tokenizer_path
from tallyweave.llm.runtime import materialize, owned, release, scratch_dir, small_side, table

#: Whose scratch tables the stages delete.
OWNER = "corpus pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on the labelled rows of the corpus) doesn't call toxic."""
    return toxicity.reject(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of smaller id holds; n_chars follows the text."""
    with owned(spark, OWNER):
        kept = line_dedup.drop_repeated_lines(docs)
    changed = F.col("__n_dropped") > 0
    return kept.withColumn("text", F.when(changed, F.col("__kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("__kept").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates."""
    release(spark, OWNER)
    with owned(spark, OWNER):
        groups = jaccard_join.jaccard_components(docs, n=5, similarity=(80, 100))
        gone = materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small_side(gone), docs["doc_id"] == F.col("__gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words."""
    release(spark, OWNER)
    with owned(spark, OWNER):
        return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    release(spark, OWNER)
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), bpe_pattern())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", dedup_documents), ("benchmark_decontamination", drop_contaminated), ("byte_bpe", tokenize)]

#: The classifier and the tokenizer have no SQL; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_dir(spark)}/tallyweave/{uuid.uuid4().hex}-pipeline"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.parquet(f"{root}/{k}_{name}")
    return docs
