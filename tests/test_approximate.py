"""Approximate vector search and mergeable summaries: what they find, and odd rows."""

from __future__ import annotations

import random

import numpy as np

from corpusloom.operators import dense, sketches


def test_clusters_are_found_in_few_buckets(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    v = spark.createDataFrame([*rows, (5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, 2.0])], "vec_id long, embedding array<float>")
    asked = v.where("vec_id % 50 = 0 AND vec_id < 2000").withColumnRenamed("vec_id", "query_id")
    exact, found = dense.dense_topk(v, asked, 10), dense.approximate_topk(v, asked, 10, tables=8, probes=4)
    r = dense.recall(found, exact).first()
    assert r["n_queries"] == 40 and r["n_true"] == 400 and r["recall"] >= 0.9
    pairs = dense.buckets(v, "vec_id", "embedding", tables=8).join(dense.buckets(asked, "query_id", "embedding", tables=8, probes=4).withColumnRenamed("id", "q"), "bucket").select("id", "q").distinct().count()
    assert pairs < 0.5 * 40 * 2000
    right = {(x["query_id"], x["vec_id"]): x["score"] for x in exact.collect()}
    assert all(right.get((x["query_id"], x["vec_id"]), x["score"]) == x["score"] for x in found.collect())


def test_vectors_of_other_lengths_and_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in dense.approximate_topk(v, asked, 2).orderBy("rank").collect()]
    assert got == [(7, 1), (7, 2)]
    assert dense.approximate_topk(v.limit(0), asked, 2).count() == 0 and dense.approximate_topk(v, asked.limit(0), 2).count() == 0
    none = dense.recall(dense.approximate_topk(v.limit(0), asked, 2), dense.dense_topk(v.limit(0), asked, 2)).first()
    assert none["n_true"] == 0 and none["recall"] is None


def test_merged_summaries_are_within_their_errors(spark):
    rng = random.Random(5)
    rows = [(k % 30, "a" if k % 3 else "b", rng.lognormvariate(0, 1) if k % 50 else None, rng.randrange(4000)) for k in range(30_000)] + [(1, "empty", None, None)]
    df = spark.createDataFrame(rows, "day int, kind string, value double, user long")
    days = sketches.summarize(df, ["kind", "day"], "value", "user")
    got = {r["kind"]: r for r in sketches.read(sketches.merge(days, ["kind"]), [0.1, 0.5, 0.99]).collect()}
    for kind in "ab":
        values = sorted(v for _, k, v, _ in rows if k == kind and v is not None)
        users = len({u for _, k, _, u in rows if k == kind})
        r = got[kind]
        assert r["n"] == len(values) and r["most"] == values[-1] and abs(r["mean"] - sum(values) / len(values)) < 1e-9
        for share, q in zip([0.1, 0.5, 0.99], r["quantile_values"], strict=True):
            rank = sum(v <= q for v in values) / len(values)
            assert abs(rank - share) <= sketches.RANK_ERROR + 1 / len(values)
        assert abs(r["distinct"] - users) <= sketches.COUNT_ERROR * users + 1
    assert got["empty"]["n"] == 0 and got["empty"]["quantile_values"] == [None, None, None] and got["empty"]["distinct"] == 0
    twice = sketches.read(sketches.merge(sketches.merge(days, ["kind"]), []), [0.5]).first()
    assert twice["n"] == sum(v is not None for _, _, v, _ in rows)


def test_no_pair_is_shuffled_and_blocks_give_the_same(spark):
    """The hits over all pairs that share a bucket, found without a join, in one block of queries and in several."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8 + i % 2).tolist()) for i in range(1500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.where("vec_id % 50 < 2").withColumnRenamed("vec_id", "query_id")
    met = dense.buckets(v, "vec_id", "embedding", tables=4).join(dense.buckets(asked, "query_id", "embedding", tables=4, probes=3).withColumnRenamed("id", "query_id"), "bucket")
    own = {}
    for q, i in met.where("(id - query_id) % 2 = 0").select("query_id", "id").distinct().collect():
        a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (q, i))
        own.setdefault(q, []).append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), i))
    want = {(q, i, r + 1) for q, hits in own.items() for r, (_, i) in enumerate(sorted(hits)[:7])}
    for block in (2048, 11):
        found = dense.approximate_topk(v, asked, 7, tables=4, probes=3, block=block)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want
