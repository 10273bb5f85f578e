"""The retrieval call: every query goes to its architecture's strategy, its hits are deduplicated and made into a context."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup, grounding
from corpusloom.storage import stored

#: A query may ask for four times the default number of hits, and never for more than fifty.
FACTOR, MOST = 4, 50

Strategy = Callable[[DataFrame, int], DataFrame]


def allowed(default_k: int) -> int:
    return min(FACTOR * default_k, MOST)


def invalid_queries(queries: DataFrame, strategies: dict[str, Strategy] | None = None, default_k: int = 5, architecture: str = "architecture") -> DataFrame:
    """(query_id, reason) of queries that :func:`retrieve` gives no hits: too many hits asked for, or an architecture that has no
    strategy (unknown or null)."""
    reason = F.when(F.coalesce("top_k", F.lit(default_k)) > allowed(default_k), "too many hits")
    if strategies is not None:
        reason = reason.when(~F.coalesce(F.col(architecture).isin(*strategies), F.lit(False)), "no such architecture")
    return queries.select("query_id", reason.alias("reason")).where("reason IS NOT NULL")


def retrieve(queries: DataFrame, strategies: dict[str, Strategy], chunks: DataFrame, default_k: int = 5, key: str = "doc_id", architecture: str = "architecture") -> DataFrame:
    """(query_id, key, rank, score, score_type, citation): the deduplicated hits of all queries in one plan.

    ``queries`` has query_id, query, top_k (null: the default) and an architecture. A strategy maps its queries and the
    largest k to ranked hits (query_id, key, rank, score); only strategies that are given run. ``chunks`` has key, source and
    text: the text joins at most k rows a query. Queries that get none are in :func:`invalid_queries`.
    """
    k = F.coalesce("top_k", F.lit(default_k))
    valid = queries.where(k <= allowed(default_k)).withColumn("_k", k)
    parts = [s(valid.where(F.col(architecture) == a), allowed(default_k)).select("query_id", key, "rank", F.col("score").cast("double").alias("score"), F.lit(SCORE_TYPES.get(a, a)).alias("score_type")) for a, s in strategies.items()]
    hits = stored(reduce(DataFrame.unionByName, parts).join(valid.select("query_id", "_k"), "query_id").where(F.col("rank") <= F.col("_k")).drop("_k"), "retrieved-hits")
    full = chunks.select(key, "source", "text").join(hits, key)
    kept = dedup.dedupe_hits(full, "source", key).select("query_id", F.col("rank").alias("_rank"), key)
    return hits.drop("rank").join(kept, ["query_id", key]).join(chunks.select(key, "source"), key).select("query_id", key, F.col("_rank").alias("rank"), "score", "score_type", T.citation(F.col("source"), F.lit(None), F.lit(None)).alias("citation"))


#: What an architecture's scores are.
SCORE_TYPES = {"document_rag": "cosine_similarity", "hierarchical_rag": "cosine_similarity", "hybrid_rag": "rrf", "research_rag": "lexical_dense", "structured_rag": "structured_match"}


def contexts(hits: DataFrame, chunks: DataFrame, chunk_id: Column, key: str = "doc_id") -> DataFrame:
    """(query_id, context) of the hits that :func:`retrieve` gives."""
    full = chunks.select(key, "text").join(hits, key).withColumn("chunk_id", chunk_id)
    return grounding.assemble_context(full)
