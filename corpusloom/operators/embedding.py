"""The slot for an embedding model: the caller brings the model, Spark brings the batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.shipping import ready


def embed(chunks: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], text: str = "text", batch_size: int = 16) -> DataFrame:
    """All columns and ``embedding``. ``make_model`` runs once a Python worker; the function it returns maps an array of
    texts to a matrix of vectors. Vectors come out with unit length."""
    ready(chunks.sparkSession)

    def load() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()
        return lambda texts: np.asarray(model(texts), np.float32)

    vectors = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return chunks.withColumn("embedding", X.l2_normalize(vectors(F.coalesce(F.col(text), F.lit("")))).cast("array<float>"))


def mean_pool(tokens: DataFrame, key: str, vector: str = "embedding", mask: str = "mask") -> DataFrame:
    """(key, vector): the mean of the rows' vectors whose mask holds, at unit length; a zero mean stays as it is.

    Sums by (key, component) are map-side combined, so a text of many tokens is no one's single task.
    """
    parts = tokens.where(F.col(mask)).select(key, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return rows.select(key, X.l2_normalize(F.transform("_v", lambda p: p["_m"])).alias(vector))
