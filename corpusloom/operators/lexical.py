"""BM25's parts: distinct tokens of a text with their counts, inverse document frequency, the best k of each query.

:mod:`corpusloom.operators.segments` stores the index and searches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


#: SQL: (term, tf) of every distinct token of the array t, counted by sorting it in the row.
_COUNTED = (
    "get(transform(filter(array(sort_array(t)), s -> size(s) > 0), s -> get(transform(array(filter(sequence(1, size(s)), i -> i = 1 OR s[i - 1] <> s[i - 2])), "
    "b -> transform(b, (i, k) -> named_struct('term', s[i - 1], 'tf', cast(coalesce(get(b, k + 1), size(s) + 1) - i AS bigint)))), 0)), 0)"
)


def idf(df: F.Column, n: F.Column) -> F.Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def top_k(hits: DataFrame, k: int, key: str = "doc_id", by: str = "score") -> DataFrame:
    """The k best hits of each query with their rank; equal scores in order of the key."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
