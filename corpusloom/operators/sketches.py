"""Stored summaries that merge: quantiles and distinct counts of any span of windows, builds or partitions without its rows.

A row of a summary table holds a KLL sketch of the values and a HyperLogLog sketch of a key, beside exact counts, sums and
bounds. Sketches are built with partial aggregation, stored as binary columns and merged by further aggregations, so a month
is merged from its days and a build from its parts. The errors are stated by :data:`RANK_ERROR` and :data:`COUNT_ERROR`; the
exact operators (:mod:`corpusloom.operators.evaluation`, :mod:`corpusloom.operators.profile`) stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: KLL's size parameter and, with it, by how much of all values the rank of a quantile may be wrong (99 % confidence).
KLL_K, RANK_ERROR = 400, 0.01
#: HyperLogLog's size (base 2 logarithm) and three standard errors of a distinct count, as a share of it.
HLL_K, COUNT_ERROR = 14, 0.025


def summarize(rows: DataFrame, group: list[str], value: str, distinct: str) -> DataFrame:
    """One summary a group: n, total, least, most, quantiles (KLL) and members (HyperLogLog). Null values and keys are not counted
    in their part; a group without any value has null sketches."""
    v = F.col(value).cast("double")
    members = F.hll_sketch_agg(F.col(distinct), HLL_K)
    return rows.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, KLL_K).alias("quantiles"), members.alias("members"))


def merge(summaries: DataFrame, group: list[str]) -> DataFrame:
    """Summaries of coarser groups (none: one row for all) from finer ones, themselves mergeable again."""
    return summaries.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles"), F.hll_union_agg("members").alias("members"))


def read(summaries: DataFrame, shares: list[float]) -> DataFrame:
    """The group's columns with n, mean, least, most, distinct (estimate) and ``quantile_values`` at ``shares``; nulls without values."""
    known = F.col("n") > 0
    at = F.array(*[F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(s))) for s in shares])
    kept = [c for c in summaries.columns if c not in ("n", "total", "least", "most", "quantiles", "members")]
    return summaries.select(*kept, "n", F.when(known, F.col("total") / F.col("n")).alias("mean"), "least", "most", F.hll_sketch_estimate("members").alias("distinct"), at.alias("quantile_values"))
