"""Artifacts, versions and builds: resolution, audits, drift and differences between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_builds(artifacts: DataFrame, versions: DataFrame, builds: DataFrame) -> DataFrame:
    """artifact -> active version -> completed build; without an active version its last one. Failures stay, with a reason."""
    w = Window.partitionBy("artifact_id").orderBy(F.desc("version_id"))
    last = versions.withColumn("r", F.row_number().over(w)).where("r = 1").select("artifact_id", F.col("version_id").alias("last_version"))
    a = artifacts.join(last, "artifact_id", "left").withColumn("version_id", F.coalesce("active_version_id", "last_version"))
    v = a.join(versions.select("artifact_id", "version_id", "build_id"), ["artifact_id", "version_id"], "left")
    b = v.join(builds.select("build_id", "status"), "build_id", "left")
    reason = F.when(F.col("build_id").isNull(), "no version").when(F.col("status").isNull(), "no build").when(F.col("status") != "completed", "not completed")
    return b.select("artifact_id", "version_id", "build_id", reason.alias("failure"))


def source_drift(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(source_id, change): missing, added or changed between two tables of source_id and sha256."""
    j = snapshot.select("source_id", F.col("sha256").alias("old")).join(current.select("source_id", F.col("sha256").alias("new")), "source_id", "full_outer")
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.withColumn("change", change).where("change IS NOT NULL").select("source_id", "change")


def unreferenced_builds(builds: DataFrame, versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Builds of deleted artifacts that no other artifact uses."""
    of_deleted = versions.join(deleted.select("artifact_id"), "artifact_id", "left_semi").select("build_id").distinct()
    still = versions.join(deleted.select("artifact_id"), "artifact_id", "left_anti").select("build_id").distinct()
    return builds.join(of_deleted, "build_id", "left_semi").join(still, "build_id", "left_anti")


def dangling_references(rows: DataFrame, key: str, refs: str, known: DataFrame, known_key: str) -> DataFrame:
    """(key, ref) of array entries that point to nothing."""
    each = rows.select(key, F.explode(refs).alias("ref"))
    return each.join(known.select(F.col(known_key).alias("ref")).distinct(), "ref", "left_anti").select(key, "ref")


def detach(rows: DataFrame, refs: str, removed: str, keep_empty) -> DataFrame:
    """Remove an id from every array; rows left without any go, unless ``keep_empty`` holds."""
    cut = rows.withColumn(refs, F.array_remove(refs, removed))
    return cut.where((F.size(refs) > 0) | keep_empty)


def set_changes(base: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """The key columns and change (added, removed or retained) of two tables of members. A full outer join of distinct rows:
    members of one artifact stay rows, so a large one is no single task's."""
    b, t = base.select(*key).distinct().withColumn("_b", F.lit(True)), target.select(*key).distinct().withColumn("_t", F.lit(True))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("retained")
    return b.join(t, key, "full_outer").select(*key, change.alias("change"))


def version_delta(base: DataFrame, target: DataFrame, artifact: str = "artifact_id", source: str = "source_id") -> DataFrame:
    """Per artifact that has both versions: how many sources were added, removed and retained, and the change of their number."""
    both = base.select(artifact).distinct().join(target.select(artifact).distinct(), artifact)
    c = set_changes(base, target, [artifact, source]).join(both, artifact, "left_semi")
    n = lambda k: F.count_if(F.col("change") == k)
    return c.groupBy(artifact).agg(n("added").alias("n_added"), n("removed").alias("n_removed"), n("retained").alias("n_retained"), (n("added") - n("removed")).alias("chunk_delta"))


def require(rows: DataFrame, failures: DataFrame, name: str, what: str) -> DataFrame:
    """``rows``, unless ``failures`` has a row: then running the plan fails and names the least of them.

    The check is part of the plan: one aggregated row whose filter raises, so nothing is counted on the driver and a plan
    with a failing part gives no partial result.
    """
    message = F.concat(F.lit(f"{what} failed: "), F.coalesce(F.min(F.col(name).cast("string")), F.lit("null")), F.lit(" (of "), F.count("*").cast("string"), F.lit(")"))
    checked = failures.agg(F.when(F.count("*") > 0, F.raise_error(message).cast("boolean")).alias("_failed"))
    return rows.crossJoin(F.broadcast(checked)).where(F.col("_failed").isNull()).drop("_failed")


def resolved_builds(artifacts: DataFrame, versions: DataFrame, builds: DataFrame) -> DataFrame:
    """As :func:`active_builds` without the failures; any failure rejects the request."""
    found = active_builds(artifacts, versions, builds)
    return require(found.drop("failure"), found.where("failure IS NOT NULL"), "artifact_id", "artifact")


def version_comparison(base: DataFrame, target: DataFrame, artifact: str = "artifact_id") -> DataFrame:
    """Per artifact that has both versions: deltas of chunk_count, vector_count and sources_count, and whether manifest_hash
    and embedding_model changed. Rows have one version each; :func:`set_changes` gives the sources themselves."""
    counts = ["chunk_count", "vector_count", "sources_count"]
    b = base.select(artifact, *(F.col(c).alias(f"_{c}") for c in (*counts, "manifest_hash", "embedding_model")))
    j = b.join(target, artifact)
    changed = [(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_changed") for c in ("manifest_hash", "embedding_model")]
    return j.select(artifact, *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in counts), *changed)


def provenance(chunks: DataFrame, sources: DataFrame, key: str = "source_id", text: str = "text") -> DataFrame:
    """Chunks with their source's name and hash (null where it is gone). The hash is taken before the join, so no text moves."""
    s = sources.select(key, "source", F.sha2(text, 256).alias("source_hash"))
    return chunks.join(s, key, "left")


def distinct_sorted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, values): the distinct values of each group in order. Distinct rows come first, so hot groups are small."""
    return rows.select(group, value).distinct().groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("values"))


def merge_ids(known, new) -> F.Column:
    """New members appended to a list that has some of them; the order of the list is kept."""
    return F.array_union(known, new)


def search_conversations(messages: DataFrame, titles: DataFrame, corpora: DataFrame, term: str) -> DataFrame:
    """conv_id of conversations whose title, first user message or attached corpus name holds the term, case ignored; an
    empty term finds all. ``titles`` has (conv_id, title), ``corpora`` (conv_id, name)."""
    low = term.strip().lower()
    if not low:
        return messages.select("conv_id").distinct()
    firsts = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    by_text = firsts.where(F.lower("said").contains(low)).select("conv_id")
    by_title = titles.where(F.lower("title").contains(low)).select("conv_id")
    return by_text.unionAll(by_title).unionAll(corpora.where(F.lower("name").contains(low)).select("conv_id")).distinct()


def integrity_audit(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, state): ok, mismatch, missing or undeclared, from file contents and declared hashes."""
    have = files.select("path", F.sha2("content", 256).alias("have"))
    j = have.join(expected.select("path", F.col("sha256").alias("want")), "path", "full_outer")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "undeclared").when(F.col("have") == F.col("want"), "ok").otherwise("mismatch")
    return j.select("path", state.alias("state"))


def session_summary(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, first user text, first and last turn. Only the minimum by turn is aggregated, no window."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min_by("text", user).alias("title"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def date_bucket(ts, as_of) -> F.Column:
    """Today, Yesterday, Previous 7 Days or Older, by whole days before ``as_of``."""
    days = F.datediff(F.to_date(as_of), F.to_date(ts))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Previous 7 Days").otherwise("Older")
