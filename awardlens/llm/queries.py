"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardlens.llm import chat_format, cnn, divergence, html_extract, license_scan, lm, minhash, mixing, packing, prefix_trie, quality_rules, simhash, url_filter
from awardlens.llm.text import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.successor_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    wanted = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
    return quality_rules.with_verdict(book).select(*wanted)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.default_list(spark))
    return found.withColumn("rule", F.when(F.col("rank") == 1, F.col("rule"))).drop("rank")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cnn.classified(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    names = ("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).cast(table.schema[n].dataType).alias(n) for n, v in zip(names, row, strict=True))) for row in chat_format.PLANTED))))
    return chat_format.digest(chat_format.examples(table.unionByName(planted)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(_table(spark, sf_dir, "documents"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.ablation(stored(book.drop("text"), "quality-ledger"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    every = (op1_license_scan, op2_language_model, op3_packing, op4_minhash, op5_quality_rules, op6_html_extract, op7_url_filter, op8_simhash, op9_quality_classifier, op10_mixing, op11_chat_format, op12_prefix_trie, op13_source_divergence, minhash_near_duplicates, quality_ablation)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query."""
    return {"op1_license_scan": license_scan.oracle(), "op5_quality_rules": quality_rules.ORACLE, "op7_url_filter": url_filter.ORACLE, "quality_ablation": quality_rules.ablation_oracle(), "op11_chat_format": chat_format.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_source_divergence": divergence.ORACLE}
