"""Queries of blocks, chunkers and samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import blocks, chunking, profile, sampling
from corpusloom.plans.registry import query, table

NAMES = ["Abstract", "Introduction", "Methods", "Results", "Discussion", "Conclusion", "References"]
LINES = "ln AS (SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS block_index, trim(s[i]) AS content, CAST((i - 1) // 40 + 1 AS INTEGER) AS page_number FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(s[i]) <> '')"
TOK = "CAST(greatest(1, trunc(len(regexp_extract_all({0}, '\\S+')) * CAST(1.33 AS DOUBLE))) AS INTEGER)"
MARKED = (
    "mk AS (SELECT doc_id, block_index, page_number, CASE WHEN block_index % 10 = 0 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN block_index = 0 THEN 1 WHEN block_index % 10 = 0 THEN 2 END AS level, "
    "CASE WHEN block_index > 0 AND block_index % 10 = 0 THEN ['Abstract', 'Introduction', 'Methods', 'Results', 'Discussion', 'Conclusion', 'References'][(block_index // 10 - 1) % 7 + 1] ELSE content END AS content FROM ln)"
)


def folded(source: str, size: int, overlap: int, at_headings: bool, tag: str = "") -> str:
    """Recursive SQL: ch(doc_id, k, s, e), the ranges of positions that are chunks, found block by block. ``tag`` ends all names."""
    return _named(_folded(source, size, overlap, at_headings), tag)


def _named(sql: str, tag: str) -> str:
    return re.sub(r"\b(bl|ag|f|fin|ch|ct)\b(?=[ .(,)])", lambda m: m[0] + tag, sql) if tag else sql


def _folded(source: str, size: int, overlap: int, at_headings: bool) -> str:
    heading = "n.type = 'heading'" if at_headings else "false"
    carry = f"coalesce(list_filter(range(f.s, n.pos + 1), lambda j: coalesce(list_sum(f.toks[j + 1 : n.pos]), 0) <= {overlap})[1], n.pos)" if overlap else "n.pos"
    return (
        f"bl AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS BIGINT) AS pos, {TOK.format('content')} AS tok FROM {source}), "
        "ag AS (SELECT doc_id, list(tok ORDER BY pos) AS toks, count(*) AS n FROM bl GROUP BY doc_id), "
        "f AS (SELECT ag.doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS s, toks[1] AS t, toks, CAST([] AS BIGINT[][]) AS cuts FROM ag "
        "UNION ALL SELECT doc_id, pos, ns, CAST(CASE WHEN closed THEN coalesce(list_sum(toks[ns + 1 : pos]), 0) + tok ELSE t + tok END AS INTEGER), toks, CASE WHEN closed THEN list_append(cuts, [s, pos]) ELSE cuts END FROM ("
        f"SELECT f.doc_id, n.pos, f.s, f.t, n.tok, f.toks, f.cuts, {heading} OR f.t + n.tok > {size} AS closed, CASE WHEN {heading} THEN n.pos WHEN f.t + n.tok > {size} THEN {carry} ELSE f.s END AS ns FROM f JOIN bl n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1)), "
        "fin AS (SELECT f.doc_id, list_append(f.cuts, [f.s, ag.n]) AS cuts FROM f JOIN ag ON f.doc_id = ag.doc_id AND f.pos = ag.n - 1), "
        "ch AS (SELECT doc_id, CAST(unnest(range(0, len(cuts))) AS INTEGER) AS k, unnest(cuts)[1] AS s, unnest(cuts)[2] AS e FROM fin), "
        "ct AS (SELECT ch.doc_id, k, s, e, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS text FROM ch JOIN bl ON bl.doc_id = ch.doc_id AND pos >= s AND pos < e GROUP BY ALL)"
    )


def marked_line(i: Column, content: Column) -> tuple[Column, Column, Column]:
    """Headings by rule: block 0 at level 1, every tenth at level 2 with a section name."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(F.floor(i / 10) - 1, F.lit(7)).cast("int") + 1)
    return F.when(i % 10 == 0, "heading").otherwise("paragraph"), F.when(i == 0, 1).when(i % 10 == 0, 2), F.when((i > 0) & (i % 10 == 0), name).otherwise(content)


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as block arrays with headings, made in their rows."""
    return chunking.line_documents(table(spark, sf_dir, "documents"), mark=marked_line)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks as a table."""
    return marked_documents(spark, sf_dir).select("doc_id", F.explode("bs").alias("b")).select("doc_id", "b.block_index", "b.type", "b.level", "b.content", "b.page_number")


HEAD = "len(regexp_extract_all(content, '\\S+')) <= {0} AND NOT regexp_matches(content, '[{1}]$') AND regexp_matches(content, '\\p{{L}}') AND (upper(content) = content OR NOT regexp_matches(content, '(^|[^\\p{{L}}])\\p{{Ll}}|\\p{{L}}\\p{{Lu}}'))"


@query(f"WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), x AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM p), b AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS part, trim(s[i]) AS content, CAST(coalesce(list_sum(list_transform(s[1 : i - 1], lambda y: len(y) + 1)), 0) AS BIGINT) AS char_offset FROM x) SELECT doc_id, part, CASE WHEN {HEAD.format(8, '.:;')} THEN 'heading' ELSE 'paragraph' END AS type, char_offset, len(content) AS n FROM b WHERE content <> ''")
def text_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.text_blocks(table(spark, sf_dir, "documents"), "\n")
    return b.select("doc_id", "part", "type", "char_offset", F.length("content").cast("long").alias("n"))


@query(f"WITH {LINES}, h AS (SELECT *, {HEAD.format(12, '.:;,')} AS h FROM ln), g AS (SELECT *, CAST(sum(CASE WHEN h OR coalesce(p, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY block_index) AS BIGINT) AS block FROM (SELECT *, lag(h) OVER (PARTITION BY doc_id, page_number ORDER BY block_index) AS p FROM h)) SELECT doc_id, page_number, block, CASE WHEN bool_or(h) THEN 'heading' ELSE 'paragraph' END AS type, sha256(string_agg(content, ' ' ORDER BY block_index)) AS digest FROM g GROUP BY ALL")
def page_lines_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = blocks.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", "page_number", F.col("block_index").alias("line_no"), F.col("content").alias("line"))
    return blocks.page_blocks(lines).select("doc_id", "page_number", "block", "type", F.sha2("content", 256).alias("digest"))


@query(f"WITH {LINES}, {MARKED} SELECT doc_id, block_index * 2 AS line_no, type, CAST(level AS INTEGER) AS level, sha256(content) AS digest FROM mk")
def markdown_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked-up blocks written as Markdown (a blank line after each) and read again."""
    m = marked(spark, sf_dir)
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "content")).otherwise(F.col("content"))
    # '|' would start a table and '- ' a list; paragraphs here are made to start with neither.
    both = m.select("doc_id", F.explode(F.array(F.struct((F.col("block_index") * 2).alias("line_no"), line.alias("line")), F.struct((F.col("block_index") * 2 + 1).alias("line_no"), F.lit("").alias("line")))).alias("l"))
    return blocks.markdown_blocks(both.select("doc_id", "l.*")).select("doc_id", "line_no", "type", "level", F.sha2("content", 256).alias("digest"))


@query(f"WITH {LINES}, {MARKED} SELECT doc_id, block_index, CASE WHEN type = 'heading' AND level = 1 THEN content ELSE (SELECT content FROM mk a WHERE a.doc_id = mk.doc_id AND a.block_index = 0) || CASE WHEN block_index >= 10 THEN ' > ' || (['Abstract', 'Introduction', 'Methods', 'Results', 'Discussion', 'Conclusion', 'References'][(block_index // 10 - 1) % 7 + 1]) ELSE '' END END AS path FROM mk")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.block_paths(marked_documents(spark, sf_dir)).select("doc_id", "block_index", F.concat_ws(" > ", "path").alias("path"))


@query(f"WITH RECURSIVE {LINES}, {MARKED}, {folded('mk', 512, 64, False)} SELECT ct.doc_id, k AS chunk_index, 'chk_' || substr(CAST(ct.doc_id AS VARCHAR), 1, 8) || '_bnd_' || lpad(CAST(k AS VARCHAR), 5, '0') || '_' || substr(sha256(text), 1, 8) AS chunk_id, {TOK.format('text')} AS token_count, p.page_number FROM ct JOIN ag USING (doc_id) JOIN bl p ON p.doc_id = ct.doc_id AND p.pos = least(n - 1, e)")
def chunk_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_boundary(marked_documents(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_id", "token_count", "page_number")


@query(f"WITH RECURSIVE {LINES}, {MARKED}, {folded('mk', 512, 64, True)} SELECT ct.doc_id, k AS chunk_index, sha256(text) AS digest, CASE WHEN h.block_index = 0 THEN (CASE WHEN regexp_matches(lower(h.content), '\\b(abstract|introduction|related work|background|methods|results|discussion|conclusion|references)\\b') THEN '?' ELSE 'body' END) ELSE ['abstract', 'introduction', 'methodology', 'results', 'discussion', 'conclusion', 'references'][(h.block_index // 10 - 1) % 7 + 1] END AS section_type FROM ct JOIN bl h ON h.doc_id = ct.doc_id AND h.pos = (SELECT max(pos) FROM bl x WHERE x.doc_id = ct.doc_id AND x.pos < e AND x.type = 'heading')")
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_section(marked_documents(spark, sf_dir)).select("doc_id", "chunk_index", F.sha2("text", 256).alias("digest"), "section_type")


CHILDREN = "mk2 AS MATERIALIZED (SELECT doc_id, block_index, page_number, content, CASE WHEN pos IN (SELECT s FROM ct p WHERE p.doc_id = b.doc_id) THEN 'heading' ELSE 'x' END AS type FROM bl b)"
PARENT_ID = "'chk_' || substr(CAST({0}.doc_id AS VARCHAR), 1, 8) || '_{1}_' || lpad(CAST({0}.k AS VARCHAR), 5, '0') || '_' || substr(sha256({0}.text), 1, 8)"


@query(
    f"WITH RECURSIVE {LINES}, {MARKED}, {folded('mk', 768, 0, True)}, {CHILDREN}, {folded('mk2', 192, 0, True, '2')} SELECT doc_id, 'parent_chunk' AS chunk_type, k AS chunk_index, {PARENT_ID.format('ct', 'par')} AS chunk_id, NULL AS parent_chunk_id FROM ct "
    f"UNION ALL SELECT c.doc_id, 'child_chunk', c.k, {PARENT_ID.format('c', 'chi')}, {PARENT_ID.format('p', 'par')} FROM ct2 c JOIN ct p ON p.doc_id = c.doc_id AND c.s >= p.s AND c.e <= p.e"
)
def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and their children."""
    return chunking.chunk_hierarchical(marked_documents(spark, sf_dir)).select("doc_id", "chunk_type", "chunk_index", "chunk_id", "parent_chunk_id")


PART_COLUMNS = ["p_name", "p_brand", "p_size"]


def part_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their row positions."""
    return sampling.numbered(table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS, F.lit("part").alias("sheet")), "sheet", "p_partkey")


@query(
    f"WITH RECURSIVE nr AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part), src AS (SELECT CAST(0 AS BIGINT) AS doc_id, n AS block_index, 'row' AS type, 'Row ' || (n + 1) || ': p_name: ' || p_name || '; p_brand: ' || p_brand || '; p_size: ' || p_size AS content FROM nr), {folded('src', 512, 0, False)} "
    "SELECT 'tabular_row' AS chunk_type, CAST(k AS BIGINT) AS chunk_index, CAST(s + 1 AS BIGINT) AS first_row, CAST(e AS BIGINT) AS last_row, sha256('Dataset: part | Sheet: main (Rows ' || (s + 1) || '–' || e || ')' || chr(10) || replace(text, chr(10) || chr(10), chr(10))) AS digest FROM ct "
    "UNION ALL SELECT 'tabular_schema', NULL, NULL, NULL, sha256('Dataset: part' || chr(10) || 'Sheet: main' || chr(10) || 'Total Rows: ' || count(*) || chr(10) || 'Total Columns: 3' || chr(10) || 'Columns & Types: p_name (string), p_brand (string), p_size (integer)') FROM part"
)
def chunk_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema chunk of a sheet and its row chunks, those of one fold over the whole table."""
    p = part_sheet(spark, sf_dir)
    rows = chunking.chunk_tabular(p, "part", PART_COLUMNS, "position")
    kinds = profile.column_profile(profile.long_cells(p, PART_COLUMNS, F.col("position")))
    schema = chunking.schema_chunk(p, "part", PART_COLUMNS, kinds)
    digest = F.sha2("text", 256).alias("digest")
    none = [F.lit(None).cast("long").alias(c) for c in ("chunk_index", "first_row", "last_row")]
    return rows.select(F.lit("tabular_row").alias("chunk_type"), "chunk_index", "first_row", "last_row", digest).unionByName(schema.select("chunk_type", *none, digest))


@query()
def token_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks, cut to 512 tokens; tested for whole texts, size and order in tests/."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return chunking.token_safe_split(docs).select("chunk_id", "sub_index", F.sha2("text", 256).alias("digest"), T.token_count(F.col("text")).alias("token_count"))


WORDS_133 = "CAST(trunc(len(regexp_extract_all({0}, '\\S+')) * CAST(1.33 AS DOUBLE)) AS INTEGER)"


@query(
    f"WITH {LINES}, {MARKED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM mk), "
    "p AS (SELECT doc_id, string_agg(repeat('#', level) || ' ' || content, chr(10) ORDER BY n) FILTER (type = 'heading') AS hs, count(*) FILTER (type = 'heading') AS n_headings, string_agg(content, chr(10) || chr(10) ORDER BY n) FILTER (total <= 6 OR n <= 3) AS head, "
    "string_agg(content, chr(10) || chr(10) ORDER BY n) FILTER (total > 6 AND n IN (total // 2, total // 2 + 1)) AS middle, string_agg(content, chr(10) || chr(10) ORDER BY n) FILTER (total > 6 AND n > total - 2) AS tail FROM r GROUP BY doc_id), "
    f"t AS (SELECT *, {WORDS_133.format('concat_ws(chr(10), hs, head, middle, tail)')} AS tokens FROM p), u AS (SELECT *, CASE WHEN tokens > 4000 THEN substr(middle, 1, 1500) ELSE middle END AS m2, CASE WHEN tokens > 4000 THEN substr(tail, 1, 1000) ELSE tail END AS t2 FROM t) "
    f"SELECT doc_id, CAST(least(50, n_headings) AS INTEGER) AS n_outline, sha256(head) AS head, sha256(m2) AS middle, sha256(t2) AS tail, CASE WHEN tokens > 4000 THEN {WORDS_133.format('concat_ws(chr(10), hs, head, m2, t2)')} ELSE tokens END AS tokens FROM u"
)
def head_middle_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sampling.document_sample(marked_documents(spark, sf_dir))
    return s.select("doc_id", F.size("outline").alias("n_outline"), *[F.sha2(c, 256).alias(c) for c in ("head", "middle", "tail")], "tokens")


SHEETS = {"customer": "c_custkey", "part": "p_partkey"}
SHEET_SAMPLE = " UNION ALL ".join(
    f"SELECT '{t}' AS sheet, part, \"at\", k FROM (SELECT 'first' AS part, row_number() OVER (ORDER BY {k}) AS \"at\", {k} AS k FROM {t} QUALIFY \"at\" <= 10 UNION ALL SELECT 'last', r, k FROM (SELECT {k} AS k, row_number() OVER (ORDER BY {k}) - (SELECT count(*) - 5 FROM {t}) AS r FROM {t}) WHERE r >= 1 "
    f"UNION ALL SELECT 'sampled', row_number() OVER (ORDER BY md5('42:' || k), k) AS z, k FROM (SELECT {k} AS k, row_number() OVER (ORDER BY {k}) AS r, count(*) OVER () AS n FROM {t}) WHERE r > 10 AND r <= n - 5 QUALIFY z <= 10)"
    for t, k in SHEETS.items()
)


@query(f"WITH s AS ({SHEET_SAMPLE}), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY sheet, \"at\") AS r FROM s) SELECT sheet, part, CAST(\"at\" AS INTEGER) AS \"at\", k FROM r WHERE r <= CASE part WHEN 'last' THEN 10 ELSE 15 END")
def first_random_last_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, seeded and last rows of the sheets of a dataset, capped over all sheets."""
    out = None
    for t, k in SHEETS.items():
        one = sampling.dataset_sample(table(spark, sf_dir, t), k).select(F.lit(t).alias("sheet"), "part", "at", F.col(k).alias("k"))
        out = one if out is None else out.unionAll(one)
    return sampling.cap_samples(out, "sheet", {"first": 15, "sampled": 15, "last": 10})


@query("(SELECT event_id, 'first' AS part FROM events ORDER BY event_id LIMIT 10) UNION ALL (SELECT event_id, 'last' FROM events ORDER BY event_id DESC LIMIT 5)")
def first_last_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of the event table."""
    return sampling.dataset_sample(table(spark, sf_dir, "events"), "event_id").where("part <> 'sampled'").select("event_id", "part")


@query("SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 10")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows by seeded hash order: the same rows for the same seed on any cluster."""
    return table(spark, sf_dir, "events").select("event_id", sampling.seeded(42, "event_id").alias("h")).orderBy("h", "event_id").limit(10).select("event_id")


ROUND = "r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents), o AS (SELECT source, row_number() OVER (ORDER BY md5('42' || source)) - 1 AS pos, count(*) OVER () AS s FROM (SELECT DISTINCT source FROM documents)), t AS (SELECT doc_id, source, (round - 1) * s + pos AS turn FROM r JOIN o USING (source))"


def probe_turns(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents"), "source", "doc_id", n)


@query(f"WITH {ROUND} SELECT doc_id, source, turn FROM t WHERE turn < (SELECT count(*) FROM documents) ORDER BY turn LIMIT 48")
def stratified_probe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_turns(spark, sf_dir, 48)


STEPS = "c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS total FROM documents), y AS (SELECT source, doc_id, n FROM c WHERE n IN (SELECT unnest(range(0, least(6, c.total))) * greatest(1, c.total // least(6, c.total))))"


@query(
    f"WITH {STEPS}, h AS (SELECT source, doc_id, 1.0 - row_number() OVER (PARTITION BY source ORDER BY doc_id) / CAST(100 AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o, 0 AS kind FROM documents WHERE doc_id % 3 = 0 QUALIFY o <= 5), "
    "b AS (SELECT source, doc_id, score, o, kind FROM h UNION ALL SELECT source, doc_id, 0.01, n, 1 FROM y WHERE (source, doc_id) NOT IN (SELECT source, doc_id FROM h)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, o) AS rank FROM b) SELECT source, doc_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each source (its first five ids divisible by three) widened by documents at equal steps through the source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    w = Window.partitionBy("source").orderBy("doc_id")
    hits = d.where("doc_id % 3 = 0").withColumn("rank", F.row_number().over(w)).where("rank <= 5").withColumn("score", 1.0 - F.col("rank") / 100)
    return sampling.widen_hits(hits, d, "source", "doc_id").select("source", "doc_id", "score", "rank")


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role FROM r WHERE n <= 8")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight messages of each conversation."""
    return sampling.history_window(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query("WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, doc_id, CASE WHEN len(text) > 280 THEN substr(text, 1, 280) || '...' ELSE text END AS snippet FROM r WHERE n <= 5")
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents a source with a snippet."""
    return sampling.first_snippets(table(spark, sf_dir, "documents"), "source", "doc_id")
