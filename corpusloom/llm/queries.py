"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, licenses, line_dedup, periodic_runs, prefix_trie, quality_crf, quality_rules, secrets, simhash, token_counts, token_store, url_filter
from corpusloom.llm.common import documents
from corpusloom.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it has the same place on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("matches")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "v2")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask_of(["few_words", "repeated_words"]))) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_upper", "n_lines", "failed")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_crf.score_documents(docs, quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "word_no", "place", "kind", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), F.round("score", 6).alias("score"), "is_secret")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(documents(spark, sf_dir), words=3, budget=2)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(documents(spark, sf_dir), repeat=True)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_decontamination, op4_bpe, op5_line_dedup, op6_url_filter, op7_quality_classifier, op8_secret_scan, op9_token_store, op10_simhash, op11_token_counts, op12_prefix_trie, op13_periodic_runs)}
