"""Queries of the artifact registry, set operations and conversations, on tables derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fusion, registry
from corpusloom.plans.registry import query, table

# artifact = source; two versions of it; a build a version, of which some are shared or not completed.
V = "ve AS (SELECT source AS artifact_id, v AS version_id, 'b' || CASE WHEN source IN ('src5', 'src6') THEN 'x' ELSE source END || '_' || v AS build_id, list(doc_id ORDER BY doc_id) AS ids FROM documents, (VALUES (0), (1)) x(v) WHERE CASE WHEN v = 0 THEN doc_id // 20 % 10 < 8 ELSE doc_id // 20 % 10 > 1 END GROUP BY source, v)"
B = "bu AS (SELECT DISTINCT build_id, CASE WHEN build_id LIKE 'bsrc7%' THEN 'failed' ELSE 'completed' END AS status FROM ve WHERE build_id NOT LIKE 'bsrc8%')"
A = "ar AS (SELECT artifact_id, CASE WHEN artifact_id IN ('src1', 'src2') THEN NULL ELSE 0 END AS active_version_id FROM ve GROUP BY artifact_id)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source, version and member; texts are not read."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    tenth = F.floor(F.col("doc_id") / 20) % 10
    inside = F.when(F.col("v") == 0, tenth < 8).otherwise(tenth > 1)
    name = F.when(F.col("source").isin("src5", "src6"), "x").otherwise(F.col("source"))
    return d.where(inside).select(F.col("source").alias("artifact_id"), F.col("v").alias("version_id"), F.concat(F.lit("b"), name, F.lit("_"), F.col("v").cast("string")).alias("build_id"), F.col("doc_id").alias("source_id"))


def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions without their members."""
    return versions(spark, sf_dir).select("artifact_id", "version_id", "build_id").distinct()


def builds(v: DataFrame) -> DataFrame:
    b = v.select("build_id").distinct().where(~F.col("build_id").startswith("bsrc8"))
    return b.withColumn("status", F.when(F.col("build_id").startswith("bsrc7"), "failed").otherwise("completed"))


@query(f"WITH {V}, {B}, {A}, r AS (SELECT ar.artifact_id, coalesce(active_version_id, 1) AS version_id FROM ar) SELECT r.artifact_id, r.version_id, ve.build_id, CASE WHEN bu.status IS NULL THEN 'no build' WHEN bu.status <> 'completed' THEN 'not completed' END AS failure FROM r JOIN ve USING (artifact_id, version_id) LEFT JOIN bu ON bu.build_id = ve.build_id")
def active_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = version_rows(spark, sf_dir)
    artifacts = v.select("artifact_id").distinct().withColumn("active_version_id", F.when(~F.col("artifact_id").isin("src1", "src2"), 0))
    return registry.active_builds(artifacts, v, builds(v))


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 10 >= 8 THEN 'added' WHEN doc_id % 10 <= 1 THEN 'missing' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 >= 8 OR doc_id % 10 <= 1 OR doc_id % 10 = 5")
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("sha256"))
    now = d.withColumn("sha256", F.when(F.col("source_id") % 10 == 5, F.reverse("sha256")).otherwise(F.col("sha256")))
    return registry.source_drift(d.where("source_id % 10 < 8"), now.where("source_id % 10 > 1"))


@query(f"WITH {V}, {B} SELECT build_id FROM bu WHERE build_id IN (SELECT build_id FROM ve WHERE artifact_id IN ('src4', 'src5')) AND build_id NOT IN (SELECT build_id FROM ve WHERE artifact_id NOT IN ('src4', 'src5'))")
def unreferenced_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds that only the deleted artifacts src4 and src5 used."""
    v = version_rows(spark, sf_dir)
    deleted = v.where(F.col("artifact_id").isin("src4", "src5")).select("artifact_id").distinct()
    return registry.unreferenced_builds(builds(v), v, deleted).select("build_id")


@query("SELECT conv_id, 'src' || k AS ref FROM (SELECT DISTINCT conv_id, conv_id % 25 AS k FROM conversations) WHERE k >= 20")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations attached to two corpora each, of which numbers from 20 do not exist."""
    name = lambda c: F.concat(F.lit("src"), c.cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("refs", F.array(name(F.col("conv_id") % 25), name(F.col("conv_id") % 3)))
    return registry.dangling_references(rows, "conv_id", "refs", table(spark, sf_dir, "documents").select("source"), "source")


@query("WITH r AS (SELECT DISTINCT conv_id, list_distinct(['src' || (conv_id % 4), 'src' || (conv_id % 3)]) AS refs FROM conversations), c AS (SELECT conv_id, list_sort(list_filter(refs, lambda x: x <> 'src2')) AS refs FROM r) SELECT conv_id, array_to_string(refs, ',') AS refs FROM c WHERE len(refs) > 0 OR conv_id = 2")
def cascade_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus src2 is deleted; conversation 2 is the default one and stays without any."""
    name = lambda c: F.concat(F.lit("src"), c.cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("refs", F.array_distinct(F.array(name(F.col("conv_id") % 4), name(F.col("conv_id") % 3))))
    return registry.detach(rows, "refs", "src2", F.col("conv_id") == 2).select("conv_id", F.concat_ws(",", F.array_sort("refs")).alias("refs"))


@query(f"WITH {V} SELECT a.artifact_id, len(list_filter(b.ids, lambda x: NOT list_contains(a.ids, x))) AS n_added, len(list_filter(a.ids, lambda x: NOT list_contains(b.ids, x))) AS n_removed, len(list_intersect(a.ids, b.ids)) AS n_retained, CAST(len(b.ids) AS BIGINT) - len(a.ids) AS chunk_delta FROM ve a JOIN ve b ON a.artifact_id = b.artifact_id AND a.version_id = 0 AND b.version_id = 1")
def version_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return registry.version_delta(v.where("version_id = 0"), v.where("version_id = 1"))


COMPARED = (
    "cv AS (SELECT source AS artifact_id, v AS version_id, sum(n_chars // 500 + 1) AS chunks, sum(CASE WHEN v = 1 AND doc_id % 40 = 0 THEN 0 ELSE n_chars // 500 + 1 END) AS vectors, count(*) AS n, sha256(CAST(sum(doc_id) AS VARCHAR)) AS hash, "
    "CASE WHEN source = 'src3' AND v = 1 THEN 'model-2' WHEN source <> 'src4' THEN 'model-1' END AS model FROM documents, (SELECT unnest([0, 1]) AS v) WHERE CASE WHEN v = 0 THEN doc_id // 20 % 10 < 8 ELSE doc_id // 20 % 10 > 1 END OR source = 'src5' GROUP BY source, v)"
)


@query(f"WITH {COMPARED} SELECT a.artifact_id, CAST(b.chunks - a.chunks AS BIGINT) AS chunk_count_delta, CAST(b.vectors - a.vectors AS BIGINT) AS vector_count_delta, b.n - a.n AS sources_count_delta, a.hash <> b.hash AS manifest_hash_changed, a.model IS DISTINCT FROM b.model AS embedding_model_changed FROM cv a JOIN cv b ON a.artifact_id = b.artifact_id AND a.version_id = 0 AND b.version_id = 1")
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of every source: one keeps its members, one changes its model, one has none."""
    i, tenth = F.col("doc_id"), F.floor(F.col("doc_id") / 20) % 10
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    d = d.where(F.when(F.col("v") == 0, tenth < 8).otherwise(tenth > 1) | (F.col("source") == "src5"))
    chunks = F.floor(F.col("n_chars") / 500) + 1
    counts = [F.sum(chunks).alias("chunk_count"), F.sum(F.when((F.col("v") == 1) & (i % 40 == 0), 0).otherwise(chunks)).alias("vector_count"), F.count("*").alias("sources_count"), F.sha2(F.sum("doc_id").cast("string"), 256).alias("manifest_hash")]
    model = F.when((F.col("artifact_id") == "src3") & (F.col("version_id") == 1), "model-2").when(F.col("artifact_id") != "src4", "model-1")
    v = d.groupBy(F.col("source").alias("artifact_id"), F.col("v").alias("version_id")).agg(*counts).withColumn("embedding_model", model)
    return registry.version_comparison(v.where("version_id = 0").drop("version_id"), v.where("version_id = 1").drop("version_id"))


@query("SELECT source AS artifact_id, doc_id AS source_id, CASE WHEN doc_id // 20 % 10 >= 8 THEN 'added' WHEN doc_id // 20 % 10 <= 1 THEN 'removed' ELSE 'retained' END AS change FROM documents")
def source_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each artifact's two versions, as rows."""
    v = versions(spark, sf_dir)
    return registry.set_changes(v.where("version_id = 0"), v.where("version_id = 1"), ["artifact_id", "source_id"])


@query("SELECT lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = registry.distinct_sorted(table(spark, sf_dir, "documents"), "lang", "source")
    return g.select("lang", F.concat_ws(",", "values").alias("sources"), F.size("values").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation once each, in order of first appearance."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "role"))).alias("rs"))
    return g.select("conv_id", F.concat_ws(",", F.transform("rs", lambda r: r["role"])).alias("roles"))


@query("WITH l AS (SELECT source, list_sort(list_distinct(list(lang))) AS ls FROM documents GROUP BY source) SELECT source, array_to_string(list_concat(['en', 'de'], list_filter(ls, lambda x: x NOT IN ('en', 'de'))), ',') AS merged FROM l")
def merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New members merged into a list that has some of them."""
    g = registry.distinct_sorted(table(spark, sf_dir, "documents"), "source", "lang")
    return g.select("source", F.concat_ws(",", registry.merge_ids(F.array(F.lit("en"), F.lit("de")), "values")).alias("merged"))


@query("SELECT conv_id, count(*) AS n_messages, min_by(text, turn) FILTER (role = 'user') AS title, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.session_summary(table(spark, sf_dir, "conversations"))


@query("SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 Days' ELSE 'Older' END AS bucket, count(*) AS n FROM (SELECT datediff('day', CAST(ts AS DATE), DATE '2024-01-30') AS d FROM events) GROUP BY ALL")
def date_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(registry.date_bucket(F.col("ts"), F.lit("2024-01-30")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT e.vec_id, d.source, sha256(d.text) AS source_hash, e.label FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 2")
def source_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the name and hash of its document, the one of twice its number."""
    chunks = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") * 2).alias("doc_id"))
    return registry.provenance(chunks, table(spark, sf_dir, "documents"), "doc_id").select("vec_id", "source", "source_hash", "label")


@query("SELECT a.vec_id, coalesce(b.vec_id, a.vec_id) AS target, b.vec_id IS NOT NULL AS has_parent FROM embeddings a LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) b ON b.vec_id = a.vec_id // 4 * 4")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child to parent, falling back to the child where the parent is gone."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    children = e.withColumn("parent_id", F.floor(F.col("vec_id") / 4) * 4)
    return fusion.parent_of(children, e.where("vec_id % 3 <> 0"), "vec_id").select("vec_id", "target", "has_parent")


@query()
def dedupe_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and unfinished sentences taken out of every text; tested against examples in tests/."""
    from corpusloom.functions.answers import dedupe_answers

    return dedupe_answers(table(spark, sf_dir, "documents")).select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.length("clean").alias("n_chars"), T.word_count(F.col("clean")).alias("n_words"))
