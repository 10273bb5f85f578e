"""A corpus pipeline of five stages, each over everything its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in the shared folder
and gives the reread table to the next. All stages but the last return the columns of ``documents``.

Null and empty texts have no quality and go in the first stage, unless there is nothing to learn quality from (no labels,
or labels of one class): then that stage keeps every document. A null doc_id loses no line and is no one's copy. Rows that
repeat a doc_id are judged one by one; of equal texts the smallest doc_id stays. Empty tables give an empty result. Columns
besides ``doc_id`` and ``text`` pass through the first four stages as they came (``n_chars`` follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, decontaminate, line_dedup, quality_crf, simhash
from corpusloom.llm.common import scratch, shared_path
from corpusloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled documents, rejects go."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents that consist of such lines alone."""
    return line_dedup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return simhash.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: token counts and digests of what is left. Workers keep a smaller cache than alone."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), cache=200_000)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark), ("bpe_encoding", tokens)]

#: SQL can't express the classifier and the tokenizer; the run is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage stores on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
