"""Recommending an index architecture for every corpus at once, from rules over its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rule -> (architecture, confidence, priority), and all options in order.
RULES = {
    "mixed_modality": ("hybrid_rag", 0.95, 100),
    "tabular_dominant": ("structured_rag", 0.9, 90),
    "scientific_research": ("research_rag", 0.85, 80),
    "hierarchical_longform": ("hierarchical_rag", 0.8, 70),
    "default_document": ("document_rag", 0.6, 10),
}
OPTIONS = ["document_rag", "hierarchical_rag", "hybrid_rag", "structured_rag", "research_rag", "graph_rag"]


def _conditions() -> dict[str, Column]:
    share = lambda m: F.coalesce(F.col("shares")[m], F.lit(0.0))
    tabular = share("tabular_dataset")
    documents = share("narrative_text") + share("hierarchical_document") + share("scientific_research")
    return {
        "mixed_modality": (documents > 0.2) & (tabular > 0.2),
        "tabular_dominant": tabular >= 0.7,
        "scientific_research": (F.col("dominant") == "scientific_research") | (share("scientific_research") >= 0.5) | (F.col("domain") == "research") | F.col("dense_research"),
        "hierarchical_longform": ((F.col("dominant") == "hierarchical_document") | (share("hierarchical_document") >= 0.5)) & (F.col("depth") >= 2),
        "default_document": F.lit(True),
    }


def matched_rules(profiles: DataFrame, corpus: str = "source") -> DataFrame:
    """One row a corpus and matched rule. Profiles have dominant, domain, shares, depth and dense_research."""
    rows = F.array(*[F.when(ok, F.struct(F.lit(r).alias("rule"), *[F.lit(v).alias(n) for n, v in zip(("architecture", "confidence", "priority"), RULES[r], strict=True)])) for r, ok in _conditions().items()])
    return profiles.select(corpus, F.explode(F.array_compact(rows)).alias("r")).select(corpus, "r.*")


def rank_rules(matched: DataFrame, corpus: str = "source") -> DataFrame:
    """Per corpus: the winning rule and the ordered alternatives (matched ones first, then the other options)."""
    order = F.expr("array_sort(collect_list(struct(-confidence AS c, -priority AS p, architecture, rule)))")
    g = matched.groupBy(corpus).agg(order.alias("rs"))
    names = F.transform("rs", lambda r: r["architecture"])
    all_ = F.array_distinct(F.concat(names, F.array(*map(F.lit, OPTIONS))))
    return g.select(corpus, F.col("rs")[0]["rule"].alias("rule"), F.col("rs")[0]["architecture"].alias("architecture"), (-F.col("rs")[0]["c"]).alias("confidence"), F.slice(all_, 2, 10).alias("alternatives"))


def recommend(profiles: DataFrame, corpus: str = "source") -> DataFrame:
    ranked = rank_rules(matched_rules(profiles, corpus), corpus)
    c = F.col("confidence")
    return ranked.withColumn("level", F.when(c >= 0.85, "high").when(c >= 0.7, "medium").otherwise("low"))


def ranked_hits(matched: DataFrame, corpus: str) -> DataFrame:
    w = Window.partitionBy(corpus).orderBy(F.desc("confidence"), F.desc("priority"))
    return matched.withColumn("rank", F.row_number().over(w))
