"""Hand-made cases for what SQL does not state, and the rules at their borders."""

from __future__ import annotations

import csv
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.answers import clean_text
from corpusloom.operators import blocks, chunking, dedup, dense, evaluation, fusion, profile, recommend, registry
from corpusloom.sources import files
from corpusloom.streaming import ingest


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,kind", [("", "null"), ("N/A", "null"), ("TRUE", "boolean"), ("-12", "integer"), ("1e5", "float"), (".5", "float"), ("2024-01-31", "datetime"), ("2024-13-31", "string"), ("1/2/2024", "datetime"), ("2024-01-31T10:00:00", "datetime"), ("abc", "string"), (None, "null")])
def test_scalar_type(spark, value, kind):
    assert one(spark, value, T.scalar_type) == kind


def test_normalize(spark):
    assert one(spark, " a\r\n\r\n\r\n\r\nb \t c d \n", T.normalize_text) == "a\n\nb c d"
    assert one(spark, "Text. --- Page 4 End --- 45-10th Unit_2.indd 45 28-11\nmore", T.normalize_for_dedup) == "text. more"


CASES = [
    ("wat is the auther?", "What is the author?", ["auther -> author", "wat is -> what is"]),
    ("young seagull", "young seagull", []),
    ("how does it work!!", "How does it work?", []),
    ("", "", []),
    ("Dr. Smith's?", "Who is Dr. Smith?", ["resolved malformed possessive entity"]),
    ("Young Seagull’s", "Young Seagull", ["resolved malformed possessive entity"]),
    ("what is Young Seagull's ?", "What is Young Seagull?", ["resolved malformed possessive entity"]),
    ("The Grumble Family auther name?", "What is the author of The Grumble Family?", ["auther -> author", "formulated natural author question"]),
    ("who is the author?", "Who is the author?", []),
    ("author of book", "What is the author of the book?", ["normalized informal author query"]),
    ("summary of the author", "summary of the author", []),
]


@pytest.mark.parametrize("query,want,changes", CASES)
def test_standardize(spark, query, want, changes):
    got = one(spark, query, T.standardized)
    assert got["query"] == want and sorted(got["changes"]) == sorted(changes)


def test_word_sets_have_boundaries(spark):
    """Words with a letter of another script or an accent give nothing, not their fragments."""
    assert sorted(one(spark, "Die Straße ist größer, über_alles naïve code_42 été abc", T.word_set)) == ["abc", "code_42", "die", "ist"]
    assert one(spark, "ünd xé", T.word_set) == []


def test_canonical_hash(spark):
    import hashlib

    df = spark.createDataFrame([(2, "x")], "b int, a string")
    assert df.select(T.canonical_hash("b", "a").alias("h")).first()["h"] == hashlib.sha256(b'{"a":"x","b":2}').hexdigest()


@pytest.mark.parametrize("heading,section", [("2. Related Work", "related_work"), ("System Design", "methodology"), ("Concluding remarks", "conclusion"), ("Chapter One", "body")])
def test_sections(spark, heading, section):
    assert one(spark, heading, T.section_of) == section


def test_answer_cleaning():
    repeated = "The cat sat on the mat today. The cat sat on the mat today. Dogs run in the park every day."
    assert clean_text(repeated) == "The cat sat on the mat today. Dogs run in the park every day."
    assert clean_text("A full sentence stands here now. And an unfinished") == "A full sentence stands here now."
    assert clean_text("") == "" and clean_text(" \n ") == " \n "
    assert clean_text("One two three four five six seven.\n\nOne two three four five six seven.") == "One two three four five six seven."


def test_answer_cleaning_of_short_sentences_and_citations():
    assert clean_text("Yes. Yes. It is so and stays so for long.") == "Yes. It is so and stays so for long."
    assert clean_text("The sky is blue over the town. [chk_a1]\n\n[chk_b2]") == "The sky is blue over the town. [chk_a1] [chk_b2]"
    assert clean_text("The sky is blue over the town [chk_a1] and more") == "The sky is blue over the town [chk_a1]"
    assert clean_text("45-10th Unit_2.indd 45\nThe text goes on after a footer line here.") == "The text goes on after a footer line here."
    first, second = "alpha beta gamma delta epsilon zeta.", "alpha beta gamma delta epsilon omega."
    assert clean_text(f"{first} {second}") == first  # 5 of 7 words, in one paragraph
    assert clean_text(f"{first}\n\nalpha beta gamma other words here.\n\nalpha beta gamma delta epsilon things.") == f"{first}\n\nalpha beta gamma other words here."
    assert clean_text("A whole sentence that stands alone here.\n\nThe poem describes how") == "A whole sentence that stands alone here."


def test_token_safe_split_keeps_all_words(spark):
    texts = ["short one", " ".join(f"w{k}." if k % 9 == 0 else f"w{k}" for k in range(2000)), "\n\n".join(" ".join(f"p{i}x{k}" for k in range(90)) + "." for i in range(12)), "x" * 5000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    rows = chunking.token_safe_split(df, 128, 0).orderBy("chunk_id", "sub_index").collect()
    for i, t in enumerate(texts):
        parts = [r["text"] for r in rows if r["chunk_id"] == i]
        assert " ".join(parts).split() == t.split()
    limits = chunking.token_safe_split(df, 128, 0).select(T.token_count(F.col("text")).alias("n")).agg(F.max("n")).first()[0]
    assert limits <= 128 * 1.33  # units are estimated one by one, and each estimate is cut to a whole number


def test_children_cover_their_parents(spark, sf_dir):
    from corpusloom.plans.chunk_queries import marked

    rows = chunking.chunk_hierarchical(chunking.by_document(marked(spark, sf_dir))).collect()
    kids = {}
    for r in sorted((r for r in rows if r["chunk_type"] == "child_chunk"), key=lambda r: (r["doc_id"], r["chunk_index"])):
        kids.setdefault((r["doc_id"], r["parent_chunk_id"]), []).append(r["text"])
    parents = {(r["doc_id"], r["chunk_id"]): r["text"] for r in rows if r["chunk_type"] == "parent_chunk"}
    assert parents == {k: "\n\n".join(v) for k, v in kids.items()}


def test_empty_blocks_give_no_chunks(spark):
    b = spark.createDataFrame([(1, 0, "paragraph", None, "", 1)], "doc_id long, block_index int, type string, level int, content string, page_number int")
    assert chunking.chunk_boundary(chunking.by_document(b)).count() == 0


def test_markdown(spark):
    text = "# Title\n\nA line\nand more\n\n- one\n- two\n\n```py\ncode | x\n```\n> said\n> so\n| a | b |\n|-|-|\n| 1 | 2 |"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, line_no int, line string")
    got = [(r["type"], r["content"]) for r in blocks.markdown_blocks(lines).orderBy("line_no").collect()]
    assert got == [("heading", "Title"), ("paragraph", "A line and more"), ("list_item", "one"), ("list_item", "two"), ("code", "code | x"), ("quote", "said so"), ("table", "| a | b |\n|-|-|\n| 1 | 2 |")]


def test_html(spark):
    html = "<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><h2>Head</h2><p>Some  <b>bold</b> text</p><ul><li>a</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><pre>a\n b</pre></body></html>"
    got = [(r["type"], r["level"], r["content"]) for r in files.html_to_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("block_index").collect()]
    assert {r["title"] for r in files.html_to_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()} == {"T"}
    assert got == [("heading", 2, "Head"), ("paragraph", None, "Some bold text"), ("list_item", None, "a"), ("table", None, "k | v\n--- | ---\n1 | 2"), ("code", None, "a\n b")]


def test_samples(spark):
    from corpusloom.operators import sampling

    rows = spark.createDataFrame([(i, "g" if i % 3 else "h") for i in range(47)], "k long, g string")
    at = {r["k"]: r["position"] for r in sampling.numbered(rows, "g", "k").collect()}
    assert all(at[k] == n for g in ("g", "h") for n, k in enumerate(k for k in range(47) if ("g" if k % 3 else "h") == g))
    for n, want in ((11, 6), (5, 5), (6, 6), (1000, 6)):
        assert sampling.systematic(spark.range(n).selectExpr("id AS k", "'x' AS g"), "g", "k").count() == want
    for n, parts in ((8, {"first": 8}), (12, {"first": 10, "last": 5}), (18, {"first": 10, "last": 5, "sampled": 10}), (40, {"first": 10, "last": 5, "sampled": 10})):
        got = sampling.dataset_sample(spark.range(n).withColumnRenamed("id", "k"), "k").collect()
        assert {p: sum(r["part"] == p for r in got) for p in {r["part"] for r in got}} == parts
        drawn = [r["k"] for r in got if r["part"] == "sampled"]
        assert n <= 20 or all(10 <= k < n - 5 for k in drawn)


def test_document_sample_is_trimmed(spark):
    from corpusloom.operators import sampling

    lines = ["# x"] + [" ".join(f"w{k}" for k in range(900)) for _ in range(8)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "a\nb")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sampling.document_sample(chunking.line_documents(docs)).collect()}
    assert len(rows[1]["middle"]) == 1500 and len(rows[1]["tail"]) == 1000 and rows[2]["middle"] is None and rows[2]["head"] == "a\n\nb"
    assert rows[1]["tokens"] == int(len("\n".join([rows[1]["head"], rows[1]["middle"], rows[1]["tail"]]).split()) * 1.33)


def test_suggested_questions(spark):
    from corpusloom.operators import questions

    chunks = spark.createDataFrame([("a", 1, "x\nHow does the pump work in winter?\n2. Design Goal\nsee", ["1. Safety rules", "Page 3"]), ("a", 2, "Did you forgot your password or login?", [])], "source string, doc_id long, text string, heading_path array<string>")
    names = spark.createDataFrame([("a", "my_file.pdf"), ("b", "")], "source string, name string")
    got = {}
    for r in questions.suggest_questions(chunks, names).orderBy("source", "rank").collect():
        got.setdefault(r["source"], []).append(r["question"])
    assert got["a"] == ["How does the pump work in winter?", "What is the design goal of this document?", "Explain the key safety rules.", "What is the main purpose of my file?"]
    assert got["b"][0] == "What is the main purpose of this document?" and len(got["b"]) == 4


def test_retrieval_caps_and_strategies(spark):
    from corpusloom.operators import retrieval

    chunks = spark.createDataFrame([(i, f"s{i % 2}", f"text number {i} of the corpus") for i in range(30)], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(1, "q", None, "document_rag"), (2, "q", 20, "hybrid_rag"), (3, "q", 21, "document_rag"), (4, "q", 3, "graph_rag")], "query_id long, query string, top_k int, architecture string")
    strategy = lambda q, k: q.select("query_id").crossJoin(chunks.select("doc_id", (F.col("doc_id") + 1).alias("rank"), (1 - F.col("doc_id") / 100).alias("score"))).where(F.col("rank") <= k)
    hits = retrieval.retrieve(asked, {"document_rag": strategy, "hybrid_rag": strategy}, chunks).collect()
    n = {i: sum(r["query_id"] == i for r in hits) for i in (1, 2, 3, 4)}
    assert n == {1: 5, 2: 20, 3: 0, 4: 0} and {r["query_id"] for r in retrieval.invalid_queries(asked).collect()} == {3}
    assert {r["score_type"] for r in hits if r["query_id"] == 2} == {"rrf"}


def test_judge_and_analyzer_slots(spark):
    from corpusloom.operators import slots

    answers = spark.createDataFrame([(1, "The cat sleeps on a warm mat.", "a warm mat and a cat that sleeps", False), (2, "I cannot find it.", "", True)], "answer_id long, answer string, context string, out_of_domain boolean")
    own = {r["answer_id"]: (r["n_claims"], r["n_supported"], r["disclaimer_ok"]) for r in slots.judge(answers).collect()}
    assert own == {1: (1, 1, True), 2: (1, 0, True)}

    def model():
        import pandas as pd

        return lambda b: pd.DataFrame({"answer_id": b["answer_id"], "n_claims": 7, "n_supported": 3, "disclaimer_ok": True})

    assert {r["n_claims"] for r in slots.judge(answers, model).collect()} == {7}
    docs = spark.createDataFrame([(1, "The patient of the Hospital")], "doc_id long, text string")
    r = slots.analyze(docs).first()
    assert (r["domain"], r["entities"]) == ("healthcare", ["Hospital"])


def test_masked_mean(spark):
    from corpusloom.operators.embedding import mean_pool

    rows = spark.createDataFrame([(1, [3.0, 0.0], True), (1, [3.0, 8.0], True), (1, [100.0, 1.0], False), (2, [0.0, 0.0], True)], "k long, embedding array<float>, mask boolean")
    assert {r["k"]: r["embedding"] for r in mean_pool(rows, "k").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_schema_chunk(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    kinds = profile.column_profile(profile.long_cells(rows, ["n", "s"], F.col("n")))
    text = chunking.schema_chunk(rows, "d", ["n", "s"], kinds).first()["text"]
    assert text == "Dataset: d\nSheet: main\nTotal Rows: 2\nTotal Columns: 2\nColumns & Types: n (integer), s (string)"


def test_formats_of_files(spark):
    def zipped(*names, mimetype=None):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n in names:
                z.writestr(n, mimetype or "x")
        return raw.getvalue()

    cfbf = bytes.fromhex("D0CF11E0A1B11AE1")
    rows = [
        ("a.docx", zipped("[Content_Types].xml", "word/document.xml")), ("a.zip", zipped("word/document.xml")), ("e.epub", zipped("mimetype", mimetype="application/epub+zip")), ("f.epub", zipped("META-INF/container.xml")), ("b.txt", b"PK\x03\x04broken"),
        ("c.pdf", b"%PDF-1.4"), ("d.md", b"\xff\xfe plain"), ("e.doc", cfbf), ("e.xls", cfbf), ("x.bin", cfbf + b"..WordDocument"), ("y.bin", cfbf), ("fake.pdf", b"col1,col2\nv1,v2\n"), ("z.dat", b"a\x00b"), ("n", b""),
        ("u.xml", b"\xef\xbb\xbf <root>x</root>"), ("x.htm", b'<?xml version="1.0"?><html xmlns="x"></html>'), ("bad.json", b"{not json"), ("big.json", b"[" + b"1, " * 60_000), ("m.markdown", b"just words"), ("w.txt", b" \n"),
    ]
    got = {r["path"]: (r["format"], r["confidence"], r["mismatch"]) for r in files.detect_format(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {
        "a.docx": ("docx", 1.0, False), "a.zip": ("unknown", 0.1, True), "e.epub": ("epub", 1.0, False), "f.epub": ("epub", 0.9, False), "b.txt": ("unknown", 0.4, True),
        "c.pdf": ("pdf", 1.0, False), "d.md": ("md", 0.9, False), "e.doc": ("doc", 0.9, False), "e.xls": ("xls", 0.9, False), "x.bin": ("doc", 0.7, True), "y.bin": ("xls", 0.7, True), "fake.pdf": ("csv", 0.95, True), "z.dat": ("unknown", 0.1, True), "n": ("empty", 1.0, False),
        "u.xml": ("xml", 0.95, False), "x.htm": ("html", 0.9, False), "bad.json": ("txt", 0.7, True), "big.json": ("json", 0.85, False), "m.markdown": ("md", 0.9, False), "w.txt": ("unknown", 0.1, True),
    }


def test_delimiters_are_found():
    rows = [["id", "a name", "note"], ["1", "x, y; z", "line one\nline two"], ["2", "p|q", 'says "hi"\tand'], ["3", "", ""]]
    for sep in ",\t;|":
        out = io.StringIO()
        csv.writer(out, delimiter=sep).writerows(rows)
        assert files.sniff_delimiter(out.getvalue()) == sep
    assert files.sniff_delimiter("one column\nonly words here") == "," and files.sniff_delimiter("", "\t") == "\t"


def test_json_blocks(spark):
    deep = '{"x": ' * 200 + "1" + "}" * 200
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "d": "x"}'), (2, "not json"), (3, None), (4, '[true, 1.5]'), (5, deep)], "id long, doc string")
    rows = files.json_flatten(df, "id", "doc").orderBy("id", "block_index").collect()
    got = [(r["id"], r["type"], r["level"], r["key_path"], r["content"]) for r in rows if r["id"] < 5]
    assert got == [
        (1, "heading", 1, "a", "a"), (1, "heading", 2, "a.b", "b"), (1, "paragraph", None, "a.b[0]", "1"), (1, "paragraph", None, "a.b[1].c", "c: None"), (1, "paragraph", None, "d", "d: x"),
        (4, "paragraph", None, "[0]", "True"), (4, "paragraph", None, "[1]", "1.5"),
    ]
    assert len([r for r in rows if r["id"] == 5]) == 200 and max(r["level"] or 0 for r in rows) == 6


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 1, "a": "x"}, {"c": true, "b": null}]')
    df = files.read_json_records(spark, str(tmp_path / "a.json"))
    assert df.columns == ["b", "a", "c"] and [tuple(r) for r in df.collect()] == [("1", "x", None), (None, None, "true")]
    (tmp_path / "b.json").write_text("[1, 2]")
    assert files.read_json_records(spark, str(tmp_path / "b.json")) is None


def test_xml_tables(spark):
    table = "<r><i><a>1</a><b> x </b></i><i><a/><b>y</b></i></r>"
    df = spark.createDataFrame([(1, table), (2, "<r><i><a>1</a></i></r>"), (3, "<r><i><a>1</a></i><i><a/><b/></i></r>"), (4, "<r>t</r>"), (5, "no xml"), (6, None), (7, '<n:r xmlns:n="u"><n:i><n:a>1</n:a></n:i><n:i><n:a>2</n:a></n:i></n:r>')], "id long, doc string")
    got = sorted(((r["id"], r["record"], r["field"], r["value"]) for r in files.xml_records(df, "id", "doc").collect()), key=repr)
    assert got == [(1, 0, "a", "1"), (1, 0, "b", "x"), (1, 1, "a", None), (1, 1, "b", "y"), (7, 0, "a", "1"), (7, 1, "a", "2")]


def test_index_checks(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    files.write_index(good, str(tmp_path / "i"), "b")
    assert files.read_index(spark, str(tmp_path / "i"), "b", 2).count() == 2
    with pytest.raises(ValueError):
        files.read_index(spark, str(tmp_path / "i"), "b", 3)
    with pytest.raises(ValueError):
        files.write_index(spark.createDataFrame([(1, [1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"), str(tmp_path / "j"), "b")


def test_dense_blocks_agree(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    one_block, many = dense.dense_topk(e, q, 3), dense.dense_topk(e, q, 3, block=10)
    assert sorted(map(tuple, one_block.collect())) == sorted(map(tuple, many.collect()))
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in dense.dense_topk(zero, asked, 5).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]


def test_corpus_dedup_equals_greedy_hits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    hits = docs.select(F.lit(1).cast("long").alias("query_id"), F.col("doc_id").alias("rank"), "doc_id", F.lit("x").alias("source"), "text")
    greedy = {r["doc_id"] for r in dedup.dedupe_hits(hits).collect()}
    assert {r["id"] for r in dedup.dedupe_corpus(docs, []).collect()} == greedy


def greedy_kept(n, edges):
    kept = set()
    for b in range(n):
        if not any(a in kept for a, x in edges if x == b):
            kept.add(b)
    return kept


@pytest.mark.parametrize("rounds,most", [(8, 200_000), (1, 200_000), (2, 5)])
def test_independent_set(spark, rounds, most):
    """A chain of 60, a clique, a star and random edges: rounds, components in one task, and components too large for one."""
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(i, j) for i in range(70, 78) for j in range(i + 1, 78)] + [(80, j) for j in range(81, 95)]
    edges += [tuple(sorted(rng.sample(range(100, 140), 2))) for _ in range(60)]
    nodes = spark.range(150).toDF("id")
    got = dedup.first_independent(nodes, spark.createDataFrame(edges, "a long, b long"), rounds, most)
    assert {r["id"] for r in got.collect()} == greedy_kept(150, edges)
    assert dedup.first_independent(nodes, spark.createDataFrame([], "a long, b long")).count() == 150


def test_large_groups_are_one_node(spark):
    """Texts of one word set in other orders, and a second set near to it: only first rows decide."""
    import random

    rng = random.Random(1)
    base = [f"word{k}" for k in range(40)]
    rows = []
    for i in range(60):
        ws = base[:] if i % 2 else [*base[:-1], "other"]
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "x"))
    rows += [(100, "too few words here", "x"), (101, "few words too here", "x"), (102, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["id"] for r in dedup.dedupe_corpus(docs, []).collect()} == {0, 100, 101}


def test_hits_of_two_corpora_stay_apart(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, 1, "c1", "a", text), (1, 2, "c2", "a", text), (1, 3, "c1", "b", text), (1, 4, "c1", "a", "other text"), (1, 5, "c2", "b", "")]
    hits = spark.createDataFrame(rows, "query_id long, rank long, corpus string, doc_id string, text string")
    got = [(r["corpus"], r["doc_id"], r["rank"]) for r in dedup.dedupe_hits(hits, ["corpus"], ["corpus", "doc_id"]).orderBy("rank").collect()]
    assert got == [("c1", "a", 1), ("c2", "a", 2)]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10, 101, 10)], "v double")
    assert evaluation.percentiles(df, "v").first()["p50"] == 55.0
    assert tuple(evaluation.percentiles(df.limit(0), "v").first()) == (0.0, 0.0)


def test_quality_score_renormalizes(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None, None, 0.5)], "h double, m double, c double, f double, ci double, d double")
    s = [r["s"] for r in df.select(evaluation.quality_score(*[F.col(c) for c in df.columns]).alias("s")).collect()]
    assert s == [100.0, 85.0]


def test_rules_at_their_borders(spark):
    rows = [("f", "slide_presentation", {"slide_presentation": 0.7, "tabular_dataset": 0.3}, 0), ("a", "narrative_text", {"tabular_dataset": 0.2, "narrative_text": 0.8}, 0), ("b", "narrative_text", {"tabular_dataset": 0.21, "narrative_text": 0.79}, 0), ("c", "tabular_dataset", {"tabular_dataset": 0.8, "narrative_text": 0.2}, 0), ("d", "hierarchical_document", {"hierarchical_document": 0.5}, 1), ("e", "hierarchical_document", {"hierarchical_document": 0.5}, 2)]
    df = spark.createDataFrame(rows, "source string, dominant string, shares map<string,double>, depth int").withColumn("domain", F.lit("general")).withColumn("dense_research", F.lit(False))
    got = {r["source"]: (r["rule"], r["level"]) for r in recommend.recommend(df).collect()}
    assert got == {"f": ("default_document", "low"), "a": ("default_document", "low"), "b": ("mixed_modality", "high"), "c": ("tabular_dominant", "high"), "d": ("default_document", "low"), "e": ("hierarchical_longform", "medium")}


def test_language_by_count_beats_first_hit(spark):
    from corpusloom.plans.registry import QUERIES

    import corpusloom.plans.profile_queries  # noqa: F401

    rows = QUERIES["language_agreement"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["count_hits"] for r in rows) > sum(r["first_hits"] for r in rows) and sum(r["count_hits"] for r in rows) > 0.9 * sum(r["n"] for r in rows)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.append_index(stream, str(tmp_path / "c"), str(tmp_path / "s"), str(tmp_path / "k")).awaitTermination()
    batch = chunking.chunk_boundary(chunking.by_document(blocks.line_blocks(docs))).select("chunk_id")
    in_row = chunking.chunk_boundary(chunking.line_documents(docs)).select("chunk_id")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, in_row.collect()))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "c")).select("chunk_id").collect()} == {r[0] for r in batch.collect()}


def test_filters_and_detach(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "id long, refs array<string>")
    assert {r["id"]: r["refs"] for r in registry.detach(rows, "refs", "b", F.col("id") == 3).collect()} == {1: ["a"], 3: []}
    chunks = spark.createDataFrame([("s", "n", 1, "t", ["Intro", "Deep Part"])], "source_id string, source_name string, page_number int, chunk_type string, heading_path array<string>")
    assert chunks.where(fusion.passes_filter(heading="deep")).count() == 1 and chunks.where(fusion.passes_filter(pages=[2])).count() == 0


def test_profile_counts_booleans(spark):
    rows = spark.createDataFrame([(0, "true"), (1, "false"), (2, "2"), (3, None)], "pos int, v string")
    cells = profile.long_cells(rows, ["v"], F.col("pos"))
    r = profile.column_profile(cells).first()
    assert (r["inferred_type"], r["null_count"], r["distinct_count"], r["min_value"], r["max_value"], r["mean_value"]) == ("boolean", 1, 3, 0.0, 2.0, 1.0)
    assert profile.column_profile(cells, "spreadsheet").first()["inferred_type"] == "boolean"
    assert re.match("string", profile.column_profile(cells, "text").first()["inferred_type"])


def test_embedding_slot(spark):
    from corpusloom.operators.embedding import embed

    def model():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = embed(spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string"), model).orderBy("id").collect()
    assert [[round(x, 4) for x in r["embedding"]] for r in rows] == [[0.9487, 0.3162], [0.0, 1.0]]


def test_members_of_equal_word_sets(spark):
    """Different texts of one word set are linked through their representative, within a scope."""
    df = spark.createDataFrame([(1, "x", "red green blue"), (2, "x", "Blue red green red"), (3, None, "green blue red"), (4, None, "red green blue"), (5, "x", "other words"), (6, "x", "a b"), (7, "x", "")], "doc_id long, source string, text string")
    assert {r["doc_id"]: r["representative"] for r in dedup.set_members(df, []).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert {r["doc_id"]: r["representative"] for r in dedup.set_members(df, ["source"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_answers_of_long_texts_without_marks():
    run = "word and more\n" * 40_000
    assert clean_text(run) == ""  # an unfinished end without any mark goes
    assert clean_text("Alpha beta gamma delta.\n12-3rd some layout_file.indd 4\nMore words stand here now.") == "Alpha beta gamma delta. More words stand here now."
    many = " ".join(f"Item{i} has value{i} under name{i} and place{i}." for i in range(5_000))
    assert clean_text(many) == many


def test_flattening_takes_string_keys_and_large_texts(spark):
    """Keys of any type; 60 texts of 1 MB give their blocks one text at a time; broken texts give none."""
    big = "[" + ",".join(f'{{"n": {i}, "pad": "{"x" * 90}"}}' for i in range(9_000)) + "]"
    df = spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 20 == 7, "{broken").otherwise(F.lit(big)).alias("doc"))
    got = files.json_flatten(df, "name", "doc").groupBy("name").agg(F.count("*").alias("n"), F.max("block_index").alias("last")).collect()
    assert len(got) == 57 and {(r["n"], r["last"]) for r in got} == {(18_000, 17_999)} and {r["name"] for r in got} >= {"k0", "k59"}
    pages = spark.createDataFrame([("a", "<title>T</title><h1>H</h1><p>x</p>"), ("b", None), (None, "<p>only</p>")], "url string, html string")
    assert [tuple(r) for r in files.html_to_blocks(pages, "url", "html").collect()] == [("a", 0, "heading", 1, "H", "T"), ("a", 1, "paragraph", None, "x", "T"), (None, 0, "paragraph", None, "only", "")]
    xml = spark.createDataFrame([(1.5, "<r><a>x</a><b><c>y</c></b></r>"), (2.5, "no xml"), (3.5, None)], "n double, doc string")
    assert [tuple(r) for r in files.xml_flatten(xml, "n", "doc").collect()] == [(1.5, 0, "heading", 1, "r"), (1.5, 1, "paragraph", None, "a: x"), (1.5, 2, "heading", 2, "b"), (1.5, 3, "paragraph", None, "c: y")]


def brute_split(text, limit, overlap):
    """The rules of token_safe_split, one text at a time."""
    tokens = lambda x: max(1, int(len(x.split()) * 1.33)) if x.split() else 0
    if tokens(text) <= limit:
        return [text]
    units = []
    for para in text.strip(" ").split("\n\n"):
        for u in re.split(r"(?<=[.!?])\s+", para) if tokens(para) > limit // 2 else [para]:
            if not u.strip(" "):
                continue
            if tokens(u.strip(" ")) <= limit:
                units.append(u.strip(" "))
                continue
            held, n = [], 0
            for w in u.split():
                t = max(1, int(len(w) * 0.35))
                if held and n + t > limit:
                    units.append(" ".join(held))
                    held, n = [], 0
                held.append(w)
                n += t
            units.append(" ".join(held))
    out, held = [], []
    for u in units:
        if held and sum(map(tokens, held)) + tokens(u) > limit:
            out.append("\n\n".join(held))
            while held and sum(map(tokens, held)) > overlap:
                held.pop(0)
        held.append(u)
    return [*out, "\n\n".join(held)]


def test_token_safe_split_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select(F.col("doc_id").alias("chunk_id"), "text")
    more = spark.createDataFrame([(10**6, "word " * 2000), (10**6 + 1, "One. Two! " * 300 + "\n\n" + "a b c. " * 200), (10**6 + 2, "short")], "chunk_id long, text string")
    for limit, overlap in ((64, 20), (512, 50)):
        both = docs.unionByName(more)
        got = {}
        for r in chunking.token_safe_split(both, limit, overlap).orderBy("chunk_id", "sub_index").collect():
            got.setdefault(r["chunk_id"], []).append(r["text"])
        assert got == {r["chunk_id"]: brute_split(r["text"], limit, overlap) for r in both.collect()}


def test_builds_are_checked(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    path = str(tmp_path / "builds")
    files.write_build(chunks, vectors, path, "one", "m")
    c, v, manifest = files.read_build(spark, path, "one")
    assert c.count() == v.count() == 2 and (manifest["dimension"], manifest["chunk_count"], manifest["embedding_model"]) == (2, 2, "m")
    for bad_chunks, bad_vectors, why in (
        (chunks.unionByName(chunks.limit(1)), vectors, "ids"), (chunks.where("chunk_id = 'a'"), vectors, "ids"), (chunks, vectors.where("chunk_id = 'a'"), "ids"),
        (chunks, vectors.withColumn("embedding", F.when(F.col("chunk_id") == "a", F.array(F.lit(1.0))).otherwise(F.col("embedding"))), "dimension"), (chunks, vectors.withColumn("embedding", F.when(F.col("chunk_id") == "a", F.col("embedding"))), "dimension"),
    ):
        with pytest.raises(ValueError, match=why):
            files.write_build(bad_chunks, bad_vectors, path, "bad", "m")
    assert not (tmp_path / "builds" / "build_id=bad").exists()
    vectors.limit(1).select(F.lit("c").alias("chunk_id"), "embedding").write.mode("append").parquet(f"{path}/build_id=one/vectors")
    with pytest.raises(ValueError, match="manifest"):
        files.read_build(spark, path, "one")
    files.write_build(chunks.limit(0), vectors.limit(0), path, "none", "m")
    assert files.read_build(spark, path, "none")[2]["chunk_count"] == 0


def test_paths_of_blocks(spark):
    kinds = [("p", None, "before"), ("h", 1, "A"), ("h", 2, "B"), ("p", None, "x"), ("h", 3, "C"), ("p", None, "y"), ("h", 2, "D"), ("h", 1, "E"), ("h", 4, "F"), ("p", None, "z")]
    rows = [(1, i, "heading" if k == "h" else "paragraph", lvl, c, 1) for i, (k, lvl, c) in enumerate(kinds)] + [(2, 0, "paragraph", None, "alone", 1), (3, 0, "heading", None, "H", 1)]
    docs = chunking.by_document(spark.createDataFrame(rows, "doc_id long, block_index int, type string, level int, content string, page_number int"))
    got = {(r["doc_id"], r["block_index"]): r["path"] for r in chunking.block_paths(docs).collect()}
    assert [got[1, i] for i in range(10)] == [[], ["A"], ["A", "B"], ["A", "B"], ["A", "B", "C"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"], ["E", "F"]]
    assert got[2, 0] == [] and got[3, 0] == ["H"] and len(got) == 12


@pytest.mark.parametrize("query,want,changes", [("what of it, en. auther name?", "What of it, en. author?", ["auther -> author"]), ("Who is the writer", "Who is the writer?", []), ("A poet's name", "A poet's name", [])])
def test_author_of_a_question(spark, query, want, changes):
    got = one(spark, query, T.standardized)
    assert got["query"] == want and got["changes"] == changes


def test_titles(spark):
    html = [
        "<TITLE lang=x>\n a &amp;&amp;\tb&amp </title><title>second</title>", "<title>x = &quot</title>", "<p>none</p>", "<title>open", None, "<title></title>",
        "<title>&amp;lt; &lt;b&gt; &quot;q&quot; &#39;&nbsp;&eacute;</title>", "<title>" + " " * 200_000,
    ]
    got = files.html_titles(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).orderBy("page_id").collect()
    assert [r["title"] for r in got] == ["a && b&amp", "x = &quot", "", "", None, "", "&lt; <b> \"q\" ' &eacute;", ""]


def test_window_percentiles_of_many_values(spark):
    """Over 10,000 values a window, repeated ones, windows with none that counts, and the borders of the ranks."""
    rows = [(1, float(x * x % 30_011) / 7 + 0.01) for x in range(25_000)] + [(2, 5.0)] * 19 + [(2, 9.0)] + [(3, 0.0), (3, None)] + [(4, 1e300), (4, 1e-300), (4, -1.0)]
    stream = spark.createDataFrame(rows, "day int, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)"))
    got = {r["start"].day: (r["n"], r["p50"], r["p95"]) for r in ingest.window_percentiles(ingest.windowed_latency(stream)).collect()}
    for day in (1, 2, 3, 4):
        values = sorted(v for d, v in rows if d == day and v and v > 0)
        at = lambda p, values=values: values[-(-len(values) * p // 100) - 1] if values else None
        assert got[day + 1] == (sum(d == day for d, _ in rows), at(50), at(95))


def test_all_cosines(spark):
    """Vectors of several lengths, zero and missing ones, in one pass and in several: as the column function, without a row lost or twice."""
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(3 + i % 2)]) for i in range(90)] + [(90, [0.0] * 3), (91, []), (92, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 9 = 0 OR vec_id > 89").select(F.col("vec_id").alias("query_id"), "embedding")
    want = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("vec_id", "query_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 5).alias("c")).collect()
    for block in (2048, 4):
        plan = dense.all_cosines(v, q, block=block)
        assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
        assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("block", [2048, 3])
def test_structured_match_of_alike_chunks_and_queries(spark, block):
    """Many chunks and queries of a few words, all with one word in common: as every pair scored one by one."""
    words = ["alpha", "beta", "betamax", "gam", "x", "größe", "7", "17"]
    chunks = [(f"c{i * 37 % 400}", "schema" if i % 97 == 0 else "rows" if i % 5 else None, f"Brand#{words[i % 8]} {words[i * i % 7]}; {words[i // 9 % 8].upper()}") for i in range(400)]
    queries = [(i, f"about {words[i % 8]} {words[i % 5]} Brand {words[i % 3]} brand") for i in range(40)] + [(40, "zzz"), (41, ""), (42, "?!"), (43, None), (44, "gam")]
    got = fusion.structured_match(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(chunks, "chunk_id string, chunk_type string, text string"), 5, block=block)
    want = set()
    for q, text in queries:
        ws = set(re.findall(r"\w+", (text or "").lower()))
        hits = []
        for c, kind, low in chunks:
            found = sum(w in low.lower() for w in ws)
            if found:
                hits.append((-round(min(1.0, round(found / len(ws), 4) + 0.1 * (kind == "schema")), 4), c))
        want |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(hits)[:5])}
    assert {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got.collect()} == want


def test_texts_topk(spark):
    """Equal texts and queries are compared once and all of them come back."""
    texts = spark.createDataFrame([(i, f"t{i % 7}") for i in range(60)] + [(None, "t1"), (60, None)], "n long, low string")
    queries = spark.createDataFrame([(i, f"q{i % 3}") for i in range(9)], "query_id long, query string")
    got = dense.texts_topk(texts, queries, 12, "n", "low", T.hash_embedding)
    vectors = texts.where("n IS NOT NULL").select("n", T.hash_embedding(F.col("low")).alias("embedding"))
    want = dense.dense_topk(vectors, queries.select("query_id", T.hash_embedding(F.col("query")).alias("embedding")), 12, "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_similar_pairs_of_large_and_crowded_sets(spark, monkeypatch):
    """Sets of 1 to 700 words at and around the threshold, two scopes that look alike, words cut into a grid: as all pairs compared."""
    monkeypatch.setattr(dedup, "COMPARED", 4)
    monkeypatch.setattr(dedup, "FREQUENT", 40)
    rng = random.Random(4)
    rows = []
    for g, n in enumerate([1, 3, 6, 7, 15, 20, 49, 50, 51, 100, 230, 700]):
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for c in range(9):
            gone = rng.sample(range(n), int(n * c * 0.02))
            words = [f"new{g}{c}{i}" if i in gone and c % 2 else w for i, w in enumerate(base) if i not in gone or c % 2]
            rows.append((len(rows), *[("a", None), (None, "a"), ("b", "a")][c % 3 if g % 2 else 0], " ".join([*words, "the", "and"])))
    docs = spark.createDataFrame(rows, "doc_id long, s string, t string, text string")
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in dedup.similar_pairs(docs, ["s", "t"]).collect()}
    first = {}
    for i, s, t, text in rows:
        first.setdefault((s, t, frozenset(w for w in text.split() if len(w) > 2)), i)
    sets = [(i, k[:2], k[2]) for k, i in first.items()]
    want = {(min(i, j), max(i, j)): round(len(x & y) / len(x | y), 9) for i, s, x in sets for j, t, y in sets if i < j and s == t and len(x & y) / len(x | y) >= 0.85}
    assert got == want and len(want) > 40


def test_corpus_dedup_shuffles_words_once(spark):
    """Only the table of distinct word sets is made from shuffled words; short, empty and repeated texts as a greedy pass keeps them."""
    rows = [(i, " ".join(f"wd{x}" for x in range(i % 4, 20 + i % 4))) for i in range(12)] + [(i, f"a{i % 3} few words") for i in range(12, 20)] + [(20, "?!"), (21, "?!"), (22, "-"), (23, ""), (24, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(dedup, "stored", lambda df, name, real=dedup.stored: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name))[1])
        got = {r["id"] for r in dedup.dedupe_corpus(docs, []).collect()}
    held = [name for name, plan in seen if "words" in plan and "Exchange hashpartitioning(set_key" in plan]
    assert held == ["word-sets"] and not [name for name, plan in seen if "Exchange hashpartitioning(hash" in plan]
    assert got == {0, 2, 12, 13, 14, 20, 22}


def test_scaling_shuffles_no_hits(spark):
    hits = spark.createDataFrame([(q, d, float(d * q)) for q in range(3) for d in range(4)], "query_id long, doc_id long, score double")
    scaled = fusion.minmax(hits, "score")
    assert "SortMergeJoin" not in scaled._jdf.queryExecution().executedPlan().toString()
    assert [r["score_scaled"] for r in scaled.orderBy("query_id", "doc_id").collect()][:8] == [0.5] * 4 + [0.0, 1 / 3, 2 / 3, 1.0]


def test_section_rerank_with_boosts_that_turn_the_order(spark):
    """Documents of one list or both, boosts that are missing, small or large, queries with few rows: as all rows scored."""
    rng = random.Random(8)
    sparse = [(q, d, round(rng.uniform(0.1, 9), 6)) for q in range(6) for d in range(80) if rng.random() < 0.8 or q == 5 and d < 2]
    dense_rows = [(q, d, round(rng.uniform(-1, 1), 6)) for q in range(7) for d in rng.sample(range(100), 10)]
    boosts = {d: rng.choice([1.0, 1.05, 1.25, 3.0]) for d in range(100) if d % 9}
    frames = [spark.createDataFrame(rows, "query_id long, doc_id long, score double") for rows in (dense_rows, sparse)]
    got = fusion.section_rerank(*frames, spark.createDataFrame(list(boosts.items()), "doc_id long, boost double"), 5)
    want = set()
    for q in range(7):
        d, b = ({i: s for x, i, s in rows if x == q} for rows in (dense_rows, sparse))
        every = {i: (d.get(i, 0.0), b.get(i, 0.0)) for i in d.keys() | b.keys()}
        low, high = min(x for _, x in every.values()), max(x for _, x in every.values())
        mixed = {i: 0.6 * min(1, max(0, (x + 1) / 2)) + 0.4 * ((y - low) / (high - low) if high > low else 0.5) for i, (x, y) in every.items()}
        best = sorted((-round(boosts[i] * m, 4), i) for i, m in mixed.items() if i in boosts)[:5]
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == want
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x]
    assert all("LeftAnti" in x for x in joins if "query_id" in x)
