"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curbline.llm import bpe, decontam, divergence, html_crf, lang_id, line_rules, secrets, simhash, substring, topk, toxicity, variants, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.train(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(pages, warc.damaged(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_segments")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_pages(_table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_language": op1_language,
        "op2_decontamination": op2_decontamination,
        "op3_warc": op3_warc,
        "op4_toxicity": op4_toxicity,
        "op5_html": op5_html,
        "op6_bpe": op6_bpe,
        "op7_substring": op7_substring,
        "op8_topk": op8_topk,
        "op9_secrets": op9_secrets,
        "op10_simhash": op10_simhash,
        "op11_line_rules": op11_line_rules,
        "op12_variants": op12_variants,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontam.ORACLE,
        "op3_warc": warc.ORACLE,
        "op7_substring": substring.ORACLE,
        "op8_topk": topk.ORACLE,
        "op11_line_rules": line_rules.ORACLE,
        "op12_variants": variants.ORACLE,
        "op13_divergence": divergence.ORACLE,
    }
