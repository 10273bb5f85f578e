"""Queries of sources, sinks and streams. What they write goes to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import registry, segments, sketches
from corpusloom.plans.registry import query, table
from corpusloom.plans.retrieval_queries import SCORES, TERMS, K, Q, text_queries
from corpusloom.sources import files
from corpusloom.storage import shared_path
from corpusloom.streaming import ingest

SAMPLES = ["", "%PDF-1.7 x", '<?xml version="1.0"?><a/>', '{"a": 1}', "a\tb\n1\t2", "a,b\n1,2", "# T\n- x\n- y", "plain", "<note>no declaration</note>", '{"a": unquoted}', "<p>x</p><html>", "  \n "]
MADE = "['', '%PDF-1.7 x', '<?xml version=\"1.0\"?><a/>', '{\"a\": 1}', 'a' || chr(9) || 'b' || chr(10) || '1' || chr(9) || '2', 'a,b' || chr(10) || '1,2', '# T' || chr(10) || '- x' || chr(10) || '- y', 'plain', '<note>no declaration</note>', '{\"a\": unquoted}', '<p>x</p><html>', '  ' || chr(10) || ' ']"


def _even(mark: str) -> str:
    return f"(len(five) > 1 AND list_min(list_transform(five, lambda l: len(l) - len(replace(l, {mark}, '')))) > 0 AND list_min(list_transform(five, lambda l: len(l) - len(replace(l, {mark}, '')))) = list_max(list_transform(five, lambda l: len(l) - len(replace(l, {mark}, '')))))"


@query(
    f"WITH d AS (SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' ELSE '' END AS path, CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'txt' ELSE '' END AS ext, CASE WHEN doc_id % 16 < 12 THEN {MADE}[doc_id % 16 + 1] ELSE text END AS c FROM documents), "
    "l AS (SELECT path, ext, c, ltrim(c, ' ' || chr(10)) AS h, list_filter(list_transform(string_split(substr(c, 1, 4096), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:20] AS lines FROM d), v AS (SELECT *, lines[1:5] AS five FROM l), "
    f"f AS (SELECT path, ext, CASE WHEN c = '' THEN 'empty 1.0 size_check' WHEN starts_with(h, '%PDF-') THEN 'pdf 1.0 magic_bytes' WHEN starts_with(h, '<') AND contains(h, '<html') THEN 'html 0.9 html_tags' WHEN starts_with(h, '<') AND contains(h, '>') THEN 'xml 0.95 xml_declaration' WHEN contains(h, '<html') THEN 'html 0.95 html_tags' WHEN (starts_with(h, '{{') OR starts_with(h, '[')) AND json_valid(c) THEN 'json 1.0 json_parse' WHEN len(lines) = 0 THEN 'unknown 0.1 unknown' WHEN {_even('chr(9)')} THEN 'tsv 0.95 delimiter_sniff' WHEN {_even(repr(','))} OR {_even(repr(';'))} THEN 'csv 0.95 delimiter_sniff' "
    "WHEN len(list_filter(lines, lambda x: starts_with(x, '#') OR starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '> ') OR starts_with(x, chr(96) || chr(96) || chr(96)) OR (contains(x, '|') AND contains(x, '-|-')))) >= 2 THEN 'md 0.8 markdown_syntax' WHEN ext = 'txt' THEN 'txt 0.85 text_encoding' ELSE 'txt 0.7 text_encoding' END AS f FROM v) "
    "SELECT path, split_part(f, ' ', 1) AS format, CAST(split_part(f, ' ', 2) AS DOUBLE) AS confidence, split_part(f, ' ', 3) AS method, split_part(f, ' ', 1) NOT IN ('empty', ext) AS mismatch FROM f UNION ALL SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.htm' ELSE '.xml' END, 'html', CAST(0.9 AS DOUBLE), 'html_tags', page_id % 3 = 2 FROM pages"
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files with extensions; three quarters of the documents are small files of a format by id."""
    n = F.col("page_id")
    named = F.concat(F.lit("p"), n.cast("string"), F.when(n % 3 == 0, ".html").when(n % 3 == 1, ".htm").otherwise(".xml"))
    pages = table(spark, sf_dir, "pages").select(named.alias("path"), F.encode("html", "UTF-8").alias("content"))
    k = F.col("doc_id")
    made = F.element_at(F.array(*map(F.lit, SAMPLES)), F.least(k % 16, F.lit(11)).cast("int") + 1)
    end = F.when(k % 3 == 0, ".csv").when(k % 3 == 1, ".TXT").otherwise("")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), k.cast("string"), end).alias("path"), F.encode(F.when(k % 16 < 12, made).otherwise(F.col("text")), "UTF-8").alias("content"))
    return files.detect_format(pages.unionByName(docs))


@query("SELECT sep, CAST(c_custkey AS VARCHAR) AS c_custkey, 'a;b, ' || c_name || chr(9) || '|' || chr(10) || 'second line' AS _count, CAST(c_nationkey AS VARCHAR) AS col_2, c_mktsegment FROM customer, (SELECT unnest([',', 'tab', ';', '|']) AS sep)")
def read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written with four separators, with quoted separators and line ends and a blank name, and read again."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("a;b, "), "c_name", F.lit("\t|\nsecond line")).alias("_count"), F.col("c_nationkey").alias(" "), "c_mktsegment")
    parts = []
    for sep, name in ((",", ","), ("\t", "tab"), (";", ";"), ("|", "|")):
        path = shared_path(spark, "delimited")
        c.write.csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        parts.append(files.read_delimited(spark, path).withColumn("sep", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 3 = 0 THEN 'yes' END AS vip FROM events")
def read_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON objects, some with a key more, and read again."""
    path = shared_path(spark, "json")
    table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.when(F.col("user_id") % 3 == 0, "yes").alias("vip")).write.json(path)
    return files.read_json_records(spark, path)


@query(
    "WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events) SELECT event_id, CAST(0 AS INTEGER) AS block_index, 'paragraph' AS type, CAST(NULL AS INTEGER) AS level, 'k' AS key_path, 'k: ' || k AS content FROM e "
    "UNION ALL SELECT event_id, 1, 'heading', 1, 'tags', 'tags' FROM e UNION ALL SELECT event_id, 2, 'paragraph', NULL, 'tags[0]', t FROM e UNION ALL SELECT event_id, 3, 'paragraph', NULL, 'tags[1].n', 'n: ' || u FROM e UNION ALL SELECT event_id, 4, 'heading', 2, 'tags[1].deep', 'deep' FROM e UNION ALL SELECT event_id, 5, 'paragraph', NULL, 'tags[1].deep.ok', 'ok: True' FROM e"
)
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props of every event with a nested list added."""
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "tags": ["'), "event_type", F.lit('", {"n": '), F.col("user_id").cast("string"), F.lit(', "deep": {"ok": true}}]}'))
    return files.json_flatten(e.select("event_id", doc.alias("doc")), "event_id", "doc")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def read_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as XML rows and read again."""
    path = shared_path(spark, "xml")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.option("rowTag", "item").option("rootTag", "items").xml(path)
    return files.read_xml_records(spark, path, "item").select("s_suppkey", "s_name")


@query("WITH b AS (SELECT s_suppkey, unnest([struct_pack(i := 0, t := 'heading', l := 1, c := 'item'), struct_pack(i := 1, t := 'paragraph', l := NULL, c := 'name: ' || s_name), struct_pack(i := 2, t := 'heading', l := 2, c := 'place'), struct_pack(i := 3, t := 'paragraph', l := NULL, c := 'nation: ' || s_nationkey)]) AS b FROM supplier) SELECT s_suppkey, CAST(b.i AS INTEGER) AS block_index, b.t AS type, CAST(b.l AS INTEGER) AS level, b.c AS content FROM b")
def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nested XML texts (with a namespace) and flattened again."""
    s = table(spark, sf_dir, "supplier")
    doc = F.concat(F.lit('<n:item xmlns:n="urn:x"><n:name>'), "s_name", F.lit("</n:name><n:place><n:nation>"), F.col("s_nationkey").cast("string"), F.lit("</n:nation></n:place></n:item>"))
    return files.xml_flatten(s.select("s_suppkey", doc.alias("doc")), "s_suppkey", "doc")


@query("WITH s AS (SELECT c_custkey // 50 AS batch, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS n, count(*) OVER (PARTITION BY c_custkey // 50) AS c FROM customer) SELECT CAST(batch AS BIGINT) AS batch, CAST(n AS INTEGER) AS record, unnest(['key', 'name']) AS field, unnest([CAST(c_custkey AS VARCHAR), c_name]) AS value FROM s WHERE c >= 2 AND batch % 3 <> 0")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most fifty customers as XML texts; every third text's first record has a field more, so it is no table."""
    c = table(spark, sf_dir, "customer").withColumn("batch", F.floor(F.col("c_custkey") / 50))
    item = F.concat(F.lit("<item><key>"), F.col("c_custkey").cast("string"), F.lit("</key><name>"), "c_name", F.lit("</name></item>"))
    g = c.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("x")))).alias("xs"))
    more = F.when(F.col("batch") % 3 == 0, "<item><a/><b/><c/></item>").otherwise("")
    doc = F.concat(F.lit("<items>"), more, F.concat_ws("", F.transform("xs", lambda x: x["x"])), F.lit("</items>"))
    return files.xml_records(g.select("batch", doc.alias("doc")), "batch", "doc")


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>\\s*(.*?)\\s*</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every page."""
    return files.html_titles(table(spark, sf_dir, "pages"))


@query()
def html_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page; order, kinds and dropped elements are tested in tests/."""
    return files.html_to_blocks(table(spark, sf_dir, "pages")).select("page_id", "block_index", "type", "level", F.sha2("content", 256).alias("digest"))


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dimension, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as two builds of an index, one of them read back with its count checked."""
    e = table(spark, sf_dir, "embeddings")
    path = shared_path(spark, "index")
    files.write_index(e, path, "b1")
    files.write_index(e.where("label = 0"), path, "b2")
    back = files.read_index(spark, path, "b1", e.count())
    return back.select("vec_id", "label", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'text of ' || vec_id AS text, label, CAST(len(embedding) AS INTEGER) AS dimension, (SELECT count(*) FROM embeddings) AS chunk_count, 'model-1' AS embedding_model FROM embeddings")
def build_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of chunks, vectors and manifest, written and read again with its checks."""
    e = table(spark, sf_dir, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    path = shared_path(spark, "builds")
    chunks = e.select("chunk_id", F.concat(F.lit("text of "), "chunk_id").alias("text"), "label")
    files.write_build(chunks, e.select("chunk_id", "embedding"), path, "b1", "model-1")
    found, vectors, manifest = files.read_build(spark, path, "b1")
    both = found.join(vectors, "chunk_id").select("chunk_id", "text", "label", F.size("embedding").alias("dimension"))
    return both.withColumns({"chunk_count": F.lit(manifest["chunk_count"]).cast("long"), "embedding_model": F.lit(manifest["embedding_model"])})


@query("SELECT 'p' || page_id AS path, CASE WHEN page_id % 10 = 0 THEN 'undeclared' WHEN page_id % 10 = 1 THEN 'mismatch' WHEN page_id % 10 = 2 THEN 'missing' ELSE 'ok' END AS state FROM pages")
def package_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as packaged files; some have no declared hash, some another one, some are gone."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    k = F.col("page_id") % 10
    declared = p.where(k != 0).select("path", F.when(k == 1, F.lit("0")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return registry.integrity_audit(p.where(k != 2), declared)


def document_stream(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """Documents as a file stream of one file a batch: dealt to files by id, so copies are spread over the batches."""
    path = shared_path(spark, "arriving")
    docs = table(spark, sf_dir, "documents")
    docs.repartition(parts, F.pmod(F.xxhash64("doc_id"), F.lit(parts))).write.parquet(path)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT doc_id, sha256(text) AS sha256, n_chars, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id AS is_duplicate FROM (SELECT doc_id, text, length(text) AS n_chars FROM documents)")
def streaming_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a stream of several files in no order of ids: every row names the first document of its content."""
    path = shared_path(spark, "registry")
    for q in ingest.register_sources(document_stream(spark, sf_dir), path, shared_path(spark, "registry-state")):
        q.awaitTermination()
    return ingest.registry(spark, path).select("doc_id", "sha256", "n_chars", "first_doc_id", "is_duplicate")


def streamed_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    """An index that four micro-batches filled."""
    root = shared_path(spark, "segments")
    ingest.append_index(document_stream(spark, sf_dir), shared_path(spark, "chunks"), root, shared_path(spark, "index-state")).awaitTermination()
    return segments.open_index(spark, root)


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term UNION ALL SELECT NULL, (SELECT count(*) FROM documents), (SELECT count(*) FROM t)")
def streaming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics merged over all batches of the stream; they equal those of one batch over everything."""
    return ingest.merged_stats(streamed_index(spark, sf_dir))


@query(f"WITH {Q}, {TERMS}, {SCORES}, h AS (SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sp WHERE rank <= {K}) SELECT 'segments' AS state, * FROM h UNION ALL SELECT 'compacted', * FROM h")
def streaming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over what the stream indexed, from its segments and again after they were compacted to one."""
    index = streamed_index(spark, sf_dir)
    asked = text_queries(spark, sf_dir)
    before = segments.search(index, asked, K).select(F.lit("segments").alias("state"), "query_id", "doc_id", "score", "rank")
    index = segments.compact(index)
    after = segments.search(index, asked, K).select(F.lit("compacted").alias("state"), "query_id", "doc_id", "score", "rank")
    segments.vacuum(index)
    return before.unionByName(after)


@query("WITH d AS (SELECT date_trunc('day', ts) AS start, value FROM events) SELECT start, count(*) AS n, quantile_disc(value, 0.5) FILTER (value > 0) AS p50, quantile_disc(value, 0.95) FILTER (value > 0) AS p95 FROM d WHERE start < (SELECT max(start) FROM d) GROUP BY start")
def streaming_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed day windows of the event stream; each percentile is one of the window's values."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    path = shared_path(spark, "latency")
    q = ingest.windowed_latency(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_path(spark, "latency-state")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    found = ingest.window_percentiles(spark.read.parquet(path))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "p50", "p95")


@query("SELECT event_type, count(value) AS n, max(value) AS most, round(avg(value), 6) AS mean, true AS quantiles_hold, true AS distinct_holds FROM events GROUP BY event_type")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of every day and event type, stored, merged to event types, and held against the exact rows: the rank of each
    quantile and the number of users are within the stated errors."""
    e = table(spark, sf_dir, "events")
    path = shared_path(spark, "summaries")
    sketches.summarize(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", "user_id").write.parquet(path)
    shares = [0.05, 0.5, 0.95]
    merged = sketches.read(sketches.merge(spark.read.parquet(path), ["event_type"]), shares)
    rows = e.select("event_type", "value", "user_id").join(merged.select("event_type", "quantile_values", "distinct"), "event_type")
    bounds = [b for i, _ in enumerate(shares) for b in (F.count_if(F.col("value") < F.col("quantile_values")[i]).alias(f"below{i}"), F.count_if(F.col("value") <= F.col("quantile_values")[i]).alias(f"upto{i}"))]
    true = rows.groupBy("event_type").agg(*bounds, F.count("value").alias("all"), F.count_distinct("user_id").alias("users"))
    held = F.lit(True)
    for i, s in enumerate(shares):
        slack = sketches.RANK_ERROR * F.col("all") + 1
        held = held & (F.col(f"below{i}") <= s * F.col("all") + slack) & (F.col(f"upto{i}") >= s * F.col("all") - slack)
    counted = F.abs(F.col("distinct") - F.col("users")) <= sketches.COUNT_ERROR * F.col("users") + 1
    return merged.join(true, "event_type").select("event_type", "n", "most", F.round("mean", 6).alias("mean"), held.alias("quantiles_hold"), counted.alias("distinct_holds"))
