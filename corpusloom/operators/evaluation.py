"""Retrieval and answer quality: hit rates, ranks, coverage, support, percentiles, composite score and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import sampling

#: Phrases with which an answer says that it has no answer.
NO_CLAIM = ["could not find", "insufficient", "not found", "does not contain", "no information"]
DISCLAIMERS = ["could not find information", "insufficient information", "insufficient evidence", "not found in the provided", "does not contain information", "no information", "cannot find", "cannot answer"]


#: Questions that no corpus answers, in the order in which they are taken.
OUT_OF_DOMAIN = [
    "What is the average surface temperature of Venus in winter?",
    "Explain the recipe for authentic Neapolitan pizza dough.",
    "What are the rules of curling in the Winter Olympic Games?",
    "Who won the 1982 FIFA World Cup final and what was the score?",
    "How do photosynthesis and cellular respiration interact in deep sea hydrothermal vents?",
    "What is the history and development of origami paper folding in Japan?",
]


def probe_split(size: int) -> tuple[int, int]:
    """How many probes of a sample are in and out of domain; a sample has 3 to 50."""
    size = max(3, min(50, size))
    out = max(1, min(2, size // 5)) if size >= 6 else 1
    return max(1, size - out), out


def generate_probes(chunks: DataFrame, size: int, key: str = "doc_id", group: str = "source", seed: int = 42) -> DataFrame:
    """(probe_id, probe_type, question, key, group): a round-robin sample of the chunks (key, group, text, heading), each
    asked by its heading or its source about its first fact, and questions out of domain."""
    n_in, n_out = probe_split(size)
    turns = sampling.stratified(chunks, group, key, n_in, seed).select(key, F.row_number().over(Window.orderBy("turn")).alias("n"))  # of n_in rows
    c = chunks.select(key, group, "heading", T.declarative_fact(F.col("text")).alias("fact")).join(F.broadcast(turns), key)
    by_heading = F.concat(F.lit("What does the section '"), "heading", F.lit("' state regarding: "), "fact", F.lit("?"))
    by_source = F.concat(F.lit("According to "), group, F.lit(", what is reported about: "), "fact", F.lit("?"))
    name = lambda kind, n: F.concat(F.lit(f"probe_{kind}_"), F.lpad(n.cast("string"), 2, "0")).alias("probe_id")
    inside = c.select(name("in", F.col("n")), F.lit("in_domain").alias("probe_type"), F.coalesce(by_heading, by_source).alias("question"), key, group)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(OUT_OF_DOMAIN[i % len(OUT_OF_DOMAIN)]).alias("question")) for i in range(n_out)])
    outside = chunks.select(F.lit(1).alias("one")).limit(1).select(F.explode(rows).alias("o"))
    null = lambda c: F.lit(None).cast(chunks.schema[c].dataType).alias(c)
    return inside.unionByName(outside.select(name("out", F.col("o.n")), F.lit("out_of_domain").alias("probe_type"), F.col("o.question").alias("question"), null(key), null(group)))


def probe_ranks(probes: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rank of each probe's own passage in its hits (null if missed), hit flags and reciprocal rank."""
    own = hits.select(F.col("query_id").alias("probe_id"), key, "rank")
    j = probes.join(own, ["probe_id", key], "left")
    within = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")
    return j.withColumns({"hit_at_1": within(1), "hit_at_3": within(3), "hit_at_5": within(5), "reciprocal_rank": F.coalesce(1.0 / F.col("rank"), F.lit(0.0))})


def retrieval_metrics(ranked: DataFrame, hit_sources: DataFrame, all_sources: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: hits@1/3/5 and MRR over the probes, the share of all sources that some hit came from, and the share of
    citations that are verified (null without any). ``cited`` has verified, one row a citation of any probe. Without probes
    hits and MRR are 0."""
    m = ranked.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(a) for c, a in (("hit_at_1", "hits_at_1"), ("hit_at_3", "hits_at_3"), ("hit_at_5", "hits_at_5"), ("reciprocal_rank", "mrr"))])
    seen = hit_sources.select("source").distinct().join(all_sources.select("source").distinct(), "source", "left_semi").agg(F.count("*").alias("seen"))
    total = all_sources.agg(F.count_distinct("source").alias("total"))
    precision = cited.agg(F.round(F.try_divide(F.count_if("verified"), F.count("*")), 4).alias("citation_precision"))
    return m.crossJoin(seen).crossJoin(total).crossJoin(precision).select("hits_at_1", "hits_at_3", "hits_at_5", "mrr", F.round(F.col("seen") / F.greatest(F.col("total"), F.lit(1)), 4).alias("source_coverage"), "citation_precision")


def claims(answer: Column) -> Column:
    """Sentences over 15 characters that claim something."""
    return F.filter(F.transform(T.sentences(answer), T.strip), lambda s: (F.length(s) > 15) & ~T.any_of(F.lower(s), NO_CLAIM))


def claim_support(answers: DataFrame) -> DataFrame:
    """answer_id, n_claims, n_supported: a claim holds if 30 % of its words of four letters or more occur in the context."""
    low = F.lower(F.col("context"))
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))
    holds = lambda s: (F.size(words(s)) > 0) & (F.size(F.filter(words(s), lambda w: low.contains(w))) >= 0.3 * F.size(words(s)))
    c = answers.withColumn("_claims", claims(F.col("answer")))
    return c.select("answer_id", F.size("_claims").cast("long").alias("n_claims"), F.size(F.filter("_claims", holds)).cast("long").alias("n_supported"))


def disclaimer_ok(answer: Column, out_of_domain: Column) -> Column:
    return T.any_of(F.lower(answer), DISCLAIMERS) == out_of_domain


def judge_metrics(judged: DataFrame) -> DataFrame:
    """One row: supported share of claims (null without claims) and right disclaimers out of domain (1 without such)."""
    n = F.count_if("out_of_domain")
    return judged.agg(F.round(F.try_divide(F.sum("n_supported"), F.sum("n_claims")), 4).alias("faithfulness"), F.coalesce(F.round(F.try_divide(F.count_if(F.col("out_of_domain") & F.col("disclaimer_ok")), n), 4), F.lit(1.0)).alias("disclaimer_accuracy"))


def percentiles(values: DataFrame, value: str, group: list[str] | None = None, exact: bool = True) -> DataFrame:
    """p50 and p95 of the values over 0, 2 decimals, 0 without any. Exact by linear interpolation, or a sketch."""
    v = F.when(F.col(value) > 0, F.col(value))
    ps = F.array(F.lit(0.5), F.lit(0.95))
    q = F.percentile(v, ps) if exact else F.percentile_approx(v, [0.5, 0.95], 10_000)
    g = values.groupBy(*(group or [])).agg(q.alias("q"))
    return g.select(*(group or []), F.coalesce(F.round(F.get("q", F.lit(0)), 2), F.lit(0.0)).alias("p50"), F.coalesce(F.round(F.get("q", F.lit(1)), 2), F.lit(0.0)).alias("p95"))


def quality_score(hits3: Column, mrr: Column, coverage: Column, faithfulness: Column, citation: Column, disclaimer: Column) -> Column:
    """Weighted mean of retrieval, faithfulness, citations and disclaimers, times 100; parts that are null drop out."""
    retrieval = 0.4 * mrr + 0.4 * hits3 + 0.2 * coverage
    parts = [(0.35, retrieval), (0.35, faithfulness), (0.15, citation), (0.15, disclaimer)]
    there = lambda c, x: F.when(c.isNotNull(), x).otherwise(0.0)
    weight, total = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        weight = weight + there(c, F.lit(w))
    for w, c in parts:
        total = total + there(c, F.round(F.lit(w) / weight, 4) * c)
    return F.round(total * 100, 2)


def delta(reports: DataFrame, metrics: list[str], base: str, target: str) -> DataFrame:
    """target - base of each metric by artifact, 4 decimals, null when a side is."""
    b = reports.where(F.col("version") == base).select("artifact_id", *[F.col(m).alias(f"b_{m}") for m in metrics])
    t = reports.where(F.col("version") == target).select("artifact_id", *[F.col(m).alias(f"t_{m}") for m in metrics])
    return b.join(t, "artifact_id").select("artifact_id", *[F.round(F.col(f"t_{m}") - F.col(f"b_{m}"), 4).alias(f"{m}_delta") for m in metrics])
