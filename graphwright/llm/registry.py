"""Queries of this subpackage for the driver, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_tree, decision_list, decontaminate, filter_audit, line_dedup, mixing, oracle, pii, prefix_trie, quality_mil, sharding, simhash_bk, sstable, substring_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarize(pii.find_spans(_documents(spark, sf_dir)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decision_list.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_sources(_documents(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_quality_classifier, op4_simhash_near_dedup, op5_substring_dedup, op6_token_tables, op7_sharding, op8_quality_rules, op9_decontamination, op10_mixing,
                                     op11_prefix_trie, op12_bpe_tree, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": oracle.LINE_DEDUP,
    "op5_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_decontamination": oracle.DECONTAMINATION,
    "op10_mixing": oracle.MIXING,
    "op11_prefix_trie": oracle.PREFIX_TRIE,
    "op13_filter_audit": oracle.FILTER_AUDIT,
}
