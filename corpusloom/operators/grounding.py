"""Evidence and citations: is the evidence enough, which citations hold, and the context that a model is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def evidence_gate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and sufficient. Overviews and queries without key terms pass; else some single hit must hold all of one or
    two key terms, or 60 % of more. A query without hits fails.

    The share is taken per hit before anything is grouped, so texts are not shuffled with their query.
    """
    asked = queries.select("query_id", T.key_terms(F.col("query")).alias("terms"), T.any_of(F.lower("query"), T.OVERVIEW).alias("overview"))
    held = hits.join(asked, "query_id").select("query_id", F.size(F.filter("terms", lambda t: F.lower("text").contains(t))).alias("found"))
    best = held.groupBy("query_id").agg(F.max("found").alias("found"))
    n = F.size("terms")
    enough = F.when(n <= 2, F.col("found") == n).otherwise(F.col("found") / n >= 0.6)
    return asked.join(best, "query_id", "left").select("query_id", (F.col("found").isNotNull() & (F.col("overview") | (n == 0) | enough)).alias("sufficient"))


def verify_citations(answers: DataFrame, hits: DataFrame, pattern: str = T.CHUNK_KEY) -> DataFrame:
    """(answer_id, chunk_id, verified) of every cited key: verified if the answer's own hits hold it."""
    cited = answers.select("answer_id", "query_id", F.explode(T.citation_keys(F.col("answer"), pattern)).alias("chunk_id"))
    own = hits.select("query_id", "chunk_id", F.lit(True).alias("own")).distinct()
    return cited.join(own, ["query_id", "chunk_id"], "left").select("answer_id", "chunk_id", F.coalesce("own", F.lit(False)).alias("verified"))


def citation_status(verified: DataFrame, answers: DataFrame) -> DataFrame:
    """Per answer, cited or not: counts of verified and fabricated keys with their status (no_citations, verified, or
    unverified_detected if any is fabricated), and counts of all marks, those with "-" among them, that the answer's hits hold
    or lack, with the support they give (none, verified, partial or unverified)."""
    ok, key = F.col("verified"), ~F.col("chunk_id").contains("-")
    counts = {"n_verified": key & ok, "n_unverified": key & ~ok, "n_held": ok, "n_lacking": ~ok}
    g = verified.groupBy("answer_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    j = answers.select("answer_id").join(g, "answer_id", "left").na.fill(0, list(counts))
    status = F.when(F.col("n_verified") + F.col("n_unverified") == 0, "no_citations").when(F.col("n_unverified") == 0, "verified").otherwise("unverified_detected")
    support = F.when(F.col("n_held") + F.col("n_lacking") == 0, "none").when(F.col("n_lacking") == 0, "verified").when(F.col("n_held") == 0, "unverified").otherwise("partial")
    return j.select("answer_id", "n_verified", "n_unverified", status.alias("status"), "n_held", "n_lacking", support.alias("support"))


def source_page_citations(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """(answer_id, query_id, name, page) citations against the answer's own hits (query_id, source_name, page_number,
    chunk_id): verified only with exactly one match. Names are compared without case; no page means any.

    The equi-join is on the query, whose hits are bounded by its k, so a source of many chunks makes no pairs.
    """
    c = cited.select("answer_id", "query_id", "name", "page").distinct()
    h = hits.select("query_id", F.lower("source_name").alias("_low"), "page_number", "chunk_id")
    m = c.join(h, (c["query_id"] == h["query_id"]) & (F.lower(c["name"]) == h["_low"]), "left").drop(h["query_id"])
    fits = F.col("chunk_id").isNotNull() & (F.col("page").isNull() | (F.col("page") == F.col("page_number")))
    g = m.groupBy("answer_id", "query_id", "name", "page").agg(F.count_if(fits).alias("n_matches"), F.min(F.when(fits, F.col("chunk_id"))).alias("chunk_id"))
    return g.select("answer_id", "name", "page", "n_matches", (F.col("n_matches") == 1).alias("verified"), F.when(F.col("n_matches") == 1, F.col("chunk_id")).alias("chunk_id"))


#: Columns that name a hit beyond doubt: with several corpora a chunk id alone does not.
IDENTITY = ["corpus_id", "build_id", "chunk_id"]


def validate_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(answer_id, valid, unverified, status) of every answer (answer_id, query_id, answer), both kinds of citations read from
    it in order: chunk keys first, then sources.

    ``hits`` has query_id, rank, chunk_id, source_name, page_number and, with several corpora, corpus_id and build_id. A key is
    valid if the answer's own hits hold it (the best one, if corpora share a chunk id); a source if exactly one hit fits its
    name and page. A hit is valid once, by its whole identity. status: no_citations, unverified_detected (anything unmatched
    or ambiguous) or verified. The hits of a query are bounded by its k, so all is done in the answer's row.
    """
    full = [F.col(c) if c in hits.columns else F.lit(None).cast("string").alias(c) for c in ("corpus_id", "build_id")]
    own = hits.select("query_id", "rank", *full, "chunk_id", "source_name", "page_number").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "corpus_id", "build_id", "chunk_id", "source_name", "page_number"))).alias("hs"))
    j = answers.join(own, "query_id", "left")
    hs = F.when(F.col("hs").isNull(), F.array_compact(F.array(F.lit(None).cast(own.schema["hs"].dataType.elementType)))).otherwise(F.col("hs"))
    j = j.select("answer_id", hs.alias("hs"), F.coalesce(T.citation_keys(F.col("answer")), F.array().cast("array<string>")).alias("keys"), F.coalesce(T.source_citations(F.col("answer")), F.array().cast("array<struct<name:string,page:int>>")).alias("sources"))
    named = lambda k: F.filter("hs", lambda h: h["chunk_id"] == k)
    fitting = lambda s: F.filter("hs", lambda h: (F.lower(h["source_name"]) == F.lower(s["name"])) & (s["page"].isNull() | (h["page_number"] == s["page"])))
    label = lambda s: F.concat(F.lit("Source: "), s["name"], F.when(s["page"] > 0, F.concat(F.lit(", p. "), s["page"].cast("string"))).otherwise(""))
    j = j.withColumns({
        "by_key": F.flatten(F.transform("keys", lambda k: F.slice(named(k), 1, 1))),
        "by_source": F.flatten(F.transform("sources", lambda s: F.when(F.size(fitting(s)) == 1, fitting(s)).otherwise(F.slice(fitting(s), 1, 0)))),
        "unverified": F.concat(F.filter("keys", lambda k: F.size(named(k)) == 0), F.transform(F.filter("sources", lambda s: F.size(fitting(s)) != 1), label)),
    })
    status = F.when((F.size("keys") == 0) & (F.size("sources") == 0), "no_citations").when(F.size("unverified") > 0, "unverified_detected").otherwise("verified")
    return j.select("answer_id", F.array_distinct(F.concat("by_key", "by_source")).alias("valid"), "unverified", status.alias("status"))


def assemble_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits' citation, id and text in rank order. A query's hits are bounded by its k."""
    part = F.concat(F.lit("--- "), "citation", F.lit(" ("), "chunk_id", F.lit(") ---\n"), "text")
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("ps"))
    return g.select("query_id", F.concat_ws("\n\n", F.transform("ps", lambda p: p["p"])).alias("context"))


#: Messages of the conversation that a prompt holds.
HISTORY = 8


def recent_history(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): the last eight messages (role, text) of each conversation in order. The cut is a ranking window that
    keeps eight rows a task before the shuffle, so a long conversation is not gathered."""
    last = messages.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("turn"), F.desc("text")))).where(F.col("_r") <= HISTORY)
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("_r", "role", "text"))))
    return last.groupBy(key).agg(ordered.alias("ms")).select(key, F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def grounded_prompt(hits: DataFrame, questions: DataFrame, history: DataFrame, instructions: str) -> DataFrame:
    """(query_id, prompt): instructions, every hit in a tag of its own with its provenance, the conversation, the question.

    All that users or documents say is escaped, so it cannot close a tag: texts and names of hits, ``history`` (query_id,
    messages: array of role and text, cut to the last eight) and ``questions`` (query_id, query). Layout footers and page marks
    go. ``hits`` has query_id, rank, chunk_id, source_name, page_number, text and, with several corpora, corpus and version.
    """
    nothing = F.lit("")
    clean = F.regexp_replace(F.coalesce("text", nothing), T.PAGE_MARK, "")
    clean = F.when(F.lower(F.coalesce("text", nothing)).contains(".indd"), F.regexp_replace(F.regexp_replace(F.coalesce("text", nothing), T.LAYOUT_FOOTER, ""), T.PAGE_MARK, "")).otherwise(clean)
    attribute = lambda name, column: F.concat(F.lit(f' {name}="'), T.escape_markup(F.coalesce(F.col(column).cast("string"), nothing)), F.lit('"'))
    several = [attribute("rag", "corpus"), attribute("version", "version")] if "corpus" in hits.columns else []
    page = F.when(F.coalesce("page_number", F.lit(0)) == 0, 1).otherwise(F.col("page_number")).cast("string")
    tag = F.concat(F.lit("<untrusted_chunk"), attribute("id", "chunk_id"), *several, attribute("source", "source_name"), F.lit(' page="'), page, F.lit('">\n'), T.escape_markup(T.strip(clean)), F.lit("\n</untrusted_chunk>"))
    chunks = hits.select("query_id", "rank", tag.alias("tag")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("tags")).select("query_id", F.array_join(F.transform("tags", lambda t: t["tag"]), "\n").alias("chunks"))
    j = questions.join(chunks, "query_id", "left").join(history, "query_id", "left")
    recent = F.when(F.size("messages") > HISTORY, F.slice("messages", -HISTORY, HISTORY)).otherwise(F.col("messages"))
    who = lambda m: F.when(m["role"] == "user", "user").otherwise("assistant")
    line = lambda m: F.concat(F.lit("<"), who(m), F.lit(">\n"), T.escape_markup(F.coalesce(m["text"], nothing)), F.lit("\n</"), who(m), F.lit(">"))
    said = F.when(F.size("messages") > 0, F.concat(F.lit("\n<conversation_history>\n"), F.array_join(F.transform(recent, line), "\n"), F.lit("\n</conversation_history>\n"))).otherwise(nothing)
    parts = [F.lit(instructions + "\n\n<grounding_context>\n"), F.coalesce("chunks", nothing), F.lit("\n</grounding_context>\n"), F.coalesce(said, nothing), F.lit("\n<user_query>\n"), T.escape_markup(F.coalesce("query", nothing)), F.lit("\n</user_query>\n\nAssistant Response:")]
    return j.select("query_id", F.concat(*parts).alias("prompt"))
