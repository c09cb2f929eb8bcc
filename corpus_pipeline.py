"""A training-corpus pipeline: documents go through language ID, near-dedup, decontamination, secret redaction and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import bpe, decontam, lang_id, secrets, simhash
from curbline.plans.session import checkpoint_dir, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Texts are long rows: batches of the default 10 000 of them would fill an executor outside its heap.
BATCH_ROWS = 500


BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bounds what a stage hands to Python at a time. The plan runs after the stage has returned, so a stage leaves the setting; run() puts
    it back."""
    spark.conf.set(BATCHES, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determinable language."""
    _small_batches(spark)
    return lang_id.keep_identified(docs, lang_id.train(docs))


#: Near copies may be unlucky under one hash: this many fingerprints of independent hashes, any of which may link, within this radius.
SEEDS, RADIUS = 3, 4


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id."""
    _small_batches(spark)
    return simhash.keep_one(docs, radius=RADIUS, seeds=SEEDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    _small_batches(spark)
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; n_chars, where there is one, counts what is left."""
    _small_batches(spark)
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    _small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: The language model and the automata are learnt, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every result lies in the shared folder before the next stage begins, and goes once that has ended."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCHES)
    folder, last = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    finally:
        spark.conf.set(BATCHES, kept)
    return docs
