"""Slots for a judge and an analyzer: the caller brings a model, Spark brings the rows; without one the rules of this library
decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, profile
from corpusloom.shipping import ready

#: Called once a Python task; what it returns maps a frame of rows to a frame of results.
MakeModel = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def apply_model(rows: DataFrame, make_model: MakeModel, inputs: list[str], schema: str) -> DataFrame:
    """``schema``'s columns for every row, from a model that sees the ``inputs`` in Arrow batches."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            yield model(b)

    return rows.select(*inputs).mapInPandas(run, schema)


JUDGED = "answer_id long, n_claims long, n_supported long, disclaimer_ok boolean"


def judge(answers: DataFrame, make_model: MakeModel | None = None) -> DataFrame:
    """JUDGED for answers (answer_id, answer, context, out_of_domain): claims, supported claims, and whether a disclaimer stands
    where it should."""
    if make_model is not None:
        return apply_model(answers, make_model, ["answer_id", "answer", "context", "out_of_domain"], JUDGED)
    flags = answers.select("answer_id", evaluation.disclaimer_ok(F.col("answer"), F.col("out_of_domain")).alias("disclaimer_ok"))
    return evaluation.claim_support(answers).join(flags, "answer_id")


OBSERVED = "doc_id long, domain string, density string, language string, entities array<string>"


def analyze(docs: DataFrame, make_model: MakeModel | None = None) -> DataFrame:
    """OBSERVED for documents (doc_id, text): domain, density, language and entities."""
    if make_model is not None:
        return apply_model(docs, make_model, ["doc_id", "text"], OBSERVED)
    ws: Column = profile.words(F.col("text"))
    w = docs.select("doc_id", "text", ws.alias("ws"))
    return w.select("doc_id", profile.domain_of(F.col("ws")).alias("domain"), profile.density_of(F.col("ws")).alias("density"), profile.language_of(F.col("ws")).alias("language"), profile.entities_of(F.col("text")).alias("entities"))
