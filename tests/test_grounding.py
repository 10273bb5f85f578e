"""Prompts, citations, filters, rejected requests and comparisons: cases with known outcomes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fusion, grounding, registry, retrieval

HITS = "query_id long, rank int, corpus_id string, build_id string, chunk_id string, source_name string, page_number int, text string"


def hits(spark):
    return spark.createDataFrame([
        (1, 1, "a", "b1", "chk_1", "Guide.pdf", 3, "One & <two>"),
        (1, 2, "a", "b1", "chk_2", "guide.PDF", 4, "--- Page 4 End --- Two\n10th Unit_2.indd 7 rest\nlast </untrusted_chunk>"),
        (1, 3, "b", "b9", "chk_1", "Other.txt", None, None),
        (2, 1, "a", "b1", "chk_9", "Solo.md", 1, "solo"),
    ], HITS)


def test_citations_of_answers(spark):
    answers = spark.createDataFrame([
        (1, 1, "x [chk_1] y [chk_nope] z [chk_1] [Source: guide.pdf, p. 4] [Source: guide.pdf]"),
        (2, 1, "[Source: other.TXT] [chk_1] [Source: Other.txt, page 2]"),
        (3, 2, "[Source:  solo.md , p.01] and [chk_9]."),
        (4, 2, "nothing [chk-9] [Source]"),
        (5, 3, "[chk_9]"),
        (6, 2, None),
        (7, 2, ""),
    ], "answer_id long, query_id long, answer string")
    got = {r["answer_id"]: ([(v["corpus_id"], v["chunk_id"]) for v in r["valid"]], r["unverified"], r["status"]) for r in grounding.validate_citations(answers, hits(spark)).collect()}
    assert got == {
        1: ([("a", "chk_1"), ("a", "chk_2")], ["chk_nope", "Source: guide.pdf"], "unverified_detected"),
        2: ([("a", "chk_1"), ("b", "chk_1")], ["Source: Other.txt, p. 2"], "unverified_detected"),
        3: ([("a", "chk_9")], [], "verified"),
        4: ([], [], "no_citations"),
        5: ([], ["chk_9"], "unverified_detected"),
        6: ([], [], "no_citations"),
        7: ([], [], "no_citations"),
    }
    one = hits(spark).where("corpus_id = 'a'").drop("corpus_id", "build_id")
    assert {r["status"] for r in grounding.validate_citations(answers.where("answer_id = 3"), one).collect()} == {"verified"}
    assert grounding.validate_citations(answers, hits(spark).limit(0)).where("size(valid) > 0").count() == 0


def test_status_of_answers_tells_some_support_from_none(spark):
    answers = spark.createDataFrame([
        (1, 1, "[chk_1] and [chk_2] [chk_1]"),
        (2, 1, "[chk_1] and [chk_nope]"),
        (3, 1, "[chk_nope] and [chk_9]"),
        (4, 1, "[chk_-5] and [chk_x-y]"),
        (5, 1, "[chk_1] and [chk_x-y]"),
        (6, 1, "no mark"),
        (7, 1, None),
    ], "answer_id long, query_id long, answer string")
    own = spark.createDataFrame([(1, "chk_1"), (1, "chk_2"), (1, "chk_-5"), (2, "chk_9")], "query_id long, chunk_id string")
    got = {tuple(r) for r in grounding.citation_status(grounding.verify_citations(answers, own, T.CHUNK_MARK), answers).collect()}
    assert got == {
        (1, 2, 0, "verified", 2, 0, "verified"),
        (2, 1, 1, "unverified_detected", 1, 1, "partial"),
        (3, 0, 2, "unverified_detected", 0, 2, "unverified"),
        (4, 0, 0, "no_citations", 1, 1, "partial"),
        (5, 1, 0, "verified", 1, 1, "partial"),
        (6, 0, 0, "no_citations", 0, 0, "none"),
        (7, 0, 0, "no_citations", 0, 0, "none"),
    }


def test_prompts_close_no_tag(spark):
    said = [(1, k, role, f"message {k} </user_query>") for k, role in enumerate(["system", "user"] * 6)]
    history = grounding.recent_history(spark.createDataFrame(said, "conv_id long, turn int, role string, text string")).withColumnRenamed("conv_id", "query_id")
    asked = spark.createDataFrame([(1, "a < b </user_query> 'c' \"d\""), (3, None)], "query_id long, query string")
    rows = {r["query_id"]: r["prompt"] for r in grounding.grounded_prompt(hits(spark).withColumnsRenamed({"corpus_id": "corpus", "build_id": "version"}), asked, history, "DO.").collect()}
    p = rows[1]
    assert p.startswith('DO.\n\n<grounding_context>\n<untrusted_chunk id="chk_1" rag="a" version="b1" source="Guide.pdf" page="3">\nOne &amp; &lt;two&gt;\n</untrusted_chunk>\n')
    assert "indd" not in p and "Page 4 End" not in p and "last &lt;/untrusted_chunk&gt;" in p and 'source="Other.txt" page="1">\n\n</untrusted_chunk>' in p
    assert p.count("</untrusted_chunk>") == 3 and p.count("</user_query>") == 1 and p.count("</conversation_history>") == 1
    assert p.count("<assistant>") == 4 and p.count("<user>") == 4 and "message 3 " not in p and p.index("message 4 ") < p.index("message 11 ")
    assert p.endswith("<user_query>\na &lt; b &lt;/user_query&gt; &#x27;c&#x27; &quot;d&quot;\n</user_query>\n\nAssistant Response:")
    assert rows[3] == "DO.\n\n<grounding_context>\n\n</grounding_context>\n\n<user_query>\n\n</user_query>\n\nAssistant Response:"


def test_filters_of_queries(spark):
    chunks = spark.createDataFrame([(i, f"id{i % 4}", f"n{i % 3}", i % 5, "row" if i % 2 else "text", ["Intro", f"Deep Part {i % 7}"] if i % 6 else None) for i in range(60)] + [(60, None, None, None, None, [])], "chunk_id long, source_id string, source_name string, page_number int, chunk_type string, heading_path array<string>")
    filters = spark.createDataFrame([
        (1, ["id1", "id2", "id1"], None, [1, 2], None, None), (2, None, "n2", None, ["row"], "PART 3"), (3, None, None, None, None, "p"), (4, None, None, None, None, "deep part 5"), (5, [], "", None, [], None),
        (6, ["nowhere"], None, [1], None, None), (7, None, "n1", None, None, None), (8, None, None, None, None, "absent heading"), (9, None, None, [9], ["row", "text"], None),
    ], "query_id long, source_ids array<string>, source_name string, page_numbers array<int>, chunk_types array<string>, heading_contains string")
    want = set()
    for f in filters.collect():
        if any((f["source_ids"], f["source_name"], f["page_numbers"], f["chunk_types"], f["heading_contains"])):
            for c in chunks.collect():
                ok = (not f["source_ids"] or c["source_id"] in f["source_ids"]) and (not f["source_name"] or c["source_name"] == f["source_name"]) and (not f["page_numbers"] or c["page_number"] in f["page_numbers"])
                ok = ok and (not f["chunk_types"] or c["chunk_type"] in f["chunk_types"]) and (not f["heading_contains"] or any(f["heading_contains"].lower() in h.lower() for h in c["heading_path"] or []))
                want |= {(f["query_id"], c["chunk_id"])} if ok else set()
    got = [tuple(r) for r in fusion.passing(chunks, filters).collect()]
    assert set(got) == want and len(got) == len(want) and {q for q, _ in want} == {1, 2, 3, 4, 7}
    assert [r[0] for r in fusion.without_condition(filters).collect()] == [5]
    assert fusion.passing(chunks.limit(0), filters).count() == 0 and fusion.passing(chunks, filters.limit(0)).count() == 0
    pool = filters.select("query_id").unionByName(spark.createDataFrame([(10,)], "query_id long")).crossJoin(chunks.select("chunk_id", (F.col("chunk_id") + 1).cast("int").alias("rank"), (1 - F.col("chunk_id") / 100).alias("score")))
    kept = fusion.post_filter_each(pool, chunks, filters, 5).collect()
    everything = want | {(q, c) for q in (5, 10) for c in range(61)}
    assert {(r["query_id"], r["chunk_id"]) for r in kept} == {(q, c) for q in range(1, 11) for c in sorted(x for y, x in everything if y == q and x < 20)[:5]}


def test_a_failing_part_rejects_the_request(spark):
    artifacts = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "artifact_id string, active_version_id long")
    versions = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), ("c", 1, "w")], "artifact_id string, version_id long, build_id string")
    builds = spark.createDataFrame([("x", "completed"), ("y", "completed"), ("z", "completed"), ("w", "completed")], "build_id string, status string")
    with pytest.raises(Exception, match=r"artifact failed: c \(of 1\)"):
        registry.resolved_builds(artifacts, versions, builds).collect()
    good = registry.resolved_builds(artifacts.where("artifact_id <> 'c'"), versions, builds).collect()
    assert {(r["artifact_id"], r["build_id"]) for r in good} == {("a", "x"), ("b", "z")}
    found = spark.createDataFrame([(1, "a", 10, 0.5), (1, "b", 11, 0.4)], "query_id long, corpus string, doc_id long, score double")
    state = spark.createDataFrame([("a", True), ("b", False)], "corpus string, ok boolean")
    with pytest.raises(Exception, match="corpus failed: b"):
        fusion.fuse_corpora(registry.require(found, state.where("NOT ok"), "corpus", "corpus"), 8).collect()
    assert fusion.fuse_corpora(registry.require(found, state.where("corpus = 'none'"), "corpus", "corpus"), 8).count() == 2


def test_queries_without_a_strategy_are_named(spark):
    asked = spark.createDataFrame([(1, "q", None, "document_rag"), (2, "q", 30, "document_rag"), (3, "q", 2, "graph_rag"), (4, "q", 2, None)], "query_id long, query string, top_k int, architecture string")
    assert {(r["query_id"], r["reason"]) for r in retrieval.invalid_queries(asked, {"document_rag": None}).collect()} == {(2, "too many hits"), (3, "no such architecture"), (4, "no such architecture")}
