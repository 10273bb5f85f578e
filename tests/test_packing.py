"""Packing of a whole table against one fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, packing


def fold(tokens, size):
    out, first, held = [], 0, 0
    for i, t in enumerate(tokens):
        if i > first and held + t > size:
            out.append((first, i - 1))
            first, held = i, 0
        held += t
    return [*out, (first, len(tokens) - 1)] if tokens else []


@pytest.mark.parametrize(("n", "size", "span", "fan"), [(0, 20, 20, 2), (1, 20, 20, 2), (5000, 20, 20, 3), (5000, 64, 100, 2), (777, 30, 259, 500), (1000, 9, 1000, 2)])
def test_equals_one_fold(spark, monkeypatch, n, size, span, fan):
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(n + size)
    tokens = [rng.choice([1, 2, 5, 9, size, size + 40]) if rng.random() < 0.1 else rng.randrange(1, 8) for _ in range(n)]
    df = spark.createDataFrame([(i, f"l{i}", t) for i, t in enumerate(tokens)], "position long, line string, tok int").repartition(5)
    got = sorted((r["chunk_index"], r["first"], r["last"], r["lines"]) for r in packing.pack(df, size, span).collect())
    assert got == [(k, a, b, [f"l{i}" for i in range(a, b + 1)]) for k, (a, b) in enumerate(fold(tokens, size))]


def test_600_000_rows(spark):
    """Several hundred spans, two levels of functions; every row is in one chunk and the chunks are those of the fold."""
    df = spark.range(600_000).select(F.col("id").alias("position"), F.lit("x").alias("line"), (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).cast("int").alias("tok"))
    tokens = [r["tok"] for r in df.orderBy("position").collect()]
    got = sorted((r["chunk_index"], r["first"], r["last"]) for r in packing.pack(df, 512, 1000).select("chunk_index", "first", "last").collect())
    assert got == [(k, a, b) for k, (a, b) in enumerate(fold(tokens, 512))]


def test_span_must_hold_a_chunk(spark):
    with pytest.raises(ValueError, match="span"):
        packing.pack(spark.range(3).select(F.col("id").alias("position"), F.lit("x").alias("line"), F.lit(1).alias("tok")), 10, 5)


def test_tabular_chunks_drop_empty_values(spark):
    df = spark.createDataFrame([(0, "a", " "), (1, None, "b"), (2, "c", "d")], "position long, x string, y string")
    rows = chunking.chunk_tabular(df, "t", ["x", "y"], "position", size=8).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["Dataset: t | Sheet: main (Rows 1–1)\nRow 1: x: a", "Dataset: t | Sheet: main (Rows 2–2)\nRow 2: y: b", "Dataset: t | Sheet: main (Rows 3–3)\nRow 3: x: c; y: d"]
