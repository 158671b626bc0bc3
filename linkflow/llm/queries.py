"""The registered queries of the subpackage: each operator over its whole table, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkflow.llm.bpe import encode_documents
from linkflow.llm.conversations import repair_report
from linkflow.llm.fingerprints import edited_likeness
from linkflow.llm.language import label_documents
from linkflow.llm.merkle import verified_manifest
from linkflow.llm.mixing import poisson_mix
from linkflow.llm.neighbours import jaccard_classes
from linkflow.llm.oracles import MERKLE_SQL, MIXING_SQL, SEARCH_SQL, SECRETS_SQL, SUBSTRINGS_SQL, URLS_SQL
from linkflow.llm.pitman_yor import score_texts
from linkflow.llm.search import top_documents
from linkflow.llm.secrets import secret_spans
from linkflow.llm.substrings import deduplicated
from linkflow.llm.urls import judge_urls
from linkflow.llm.warc import derive, response_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(response_records(table(spark, sf_dir, "pages")))


def op5_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_copy", "mix_key", "text")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_fingerprints, op3_jaccard_join, op4_warc_derivatives, op5_bm25_top_k,
        op6_source_mixing, op7_secret_scans, op8_substring_dedup, op9_url_filters, op10_bpe,
        op11_lm_scoring, op12_merkle_manifest, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op5_bm25_top_k": SEARCH_SQL, "op6_source_mixing": MIXING_SQL, "op7_secret_scans": SECRETS_SQL,
            "op8_substring_dedup": SUBSTRINGS_SQL, "op9_url_filters": URLS_SQL, "op12_merkle_manifest": MERKLE_SQL}
