"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dense, embedding, profile
from corpusloom.plans.registry import query, table
from corpusloom.sources import files

NORM = "trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g'))"
# RE2 has no look-around: words of all scripts are found first, and those of ASCII letters, digits and underscores kept.
WORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]{3,}')))"


@query(
    """SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' '), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
       lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10)), ' ' || chr(10))) AS normalized_sha256 FROM documents"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("normalized_sha256"))


@query(
    """WITH b AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t]+', ' ', 'g')) AS content FROM documents)
       SELECT doc_id, count(*) AS n_blocks, CAST(sum(len(regexp_extract_all(content, '\\S+'))) AS BIGINT) AS n_words FROM b WHERE content <> '' GROUP BY doc_id"""
)
def normalize_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    content = blocks.select("doc_id", T.normalize_text(F.col("raw")).alias("content")).where("content <> ''")
    return content.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(T.word_count(F.col("content"))).alias("n_words"))


@query("SELECT c_custkey AS custkey, trim(c_name) AS name, trim(c_mktsegment) AS mktsegment FROM customer")
def normalize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String cells and column names trimmed."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" custkey"), F.col("c_name").alias("name "), F.concat(F.lit(" "), "c_mktsegment").alias(" mktsegment"))
    return files.normalize_cells(customer)


@query("SELECT doc_id, CAST(CASE WHEN n > 0 THEN greatest(1, trunc(n * CAST(1.33 AS DOUBLE))) ELSE 0 END AS INTEGER) AS n_tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def estimate_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(
    """WITH b AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
       SELECT doc_id, i AS block_index, 'chk_' || replace(substr(source || '-' || doc_id, 1, 8), '-', '') || '_blk_' || lpad(CAST(i AS VARCHAR), 5, '0') || '_' || substr(sha256(content), 1, 8) AS chunk_id FROM b"""
)
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    source_id = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return b.select("doc_id", F.col("i").cast("long").alias("block_index"), T.chunk_id(source_id, "blk", F.col("i"), F.col("content")).alias("chunk_id"))


@query(f"SELECT doc_id, sha256({NORM}) AS fingerprint, len({NORM}) AS n_chars FROM documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the text that deduplication compares (markers and footers removed)."""
    norm = T.normalize_for_dedup(F.concat_ws(" ", F.lit("--- Page 3 End ---"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm, 256).alias("fingerprint"), F.length(norm).cast("long").alias("n_chars"))


@query(f"SELECT doc_id, len({WORDS}) AS n_words, sha256(array_to_string(list_sort({WORDS}), ' ')) AS words_sha256 FROM documents")
def word_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.word_set(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.sha2(F.concat_ws(" ", F.array_sort(words)), 256).alias("words_sha256"))


@query(
    f"""WITH w AS (SELECT doc_id, source, {WORDS} AS ws FROM documents), p AS (SELECT a.doc_id, b.doc_id AS other_id, a.ws AS x, b.ws AS y FROM w a JOIN w b ON a.source = b.source AND b.doc_id = a.doc_id + 20)
       SELECT doc_id, other_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE) END, 6) AS jaccard FROM p"""
)
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-set similarity of each document and the one of its source that comes 20 ids later."""
    w = table(spark, sf_dir, "documents").select("doc_id", "source", T.word_set(F.col("text")).alias("ws"))
    later = w.select(F.col("doc_id").alias("other_id"), (F.col("doc_id") - 20).alias("doc_id"), "source", F.col("ws").alias("other"))
    return w.join(later, ["doc_id", "source"]).select("doc_id", "other_id", F.round(T.jaccard(F.col("ws"), F.col("other")), 6).alias("jaccard"))


@query("SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token, t[-1] AS last_token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)")
def bm25_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


CELLS = """SELECT 'props' AS col, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS v FROM events UNION ALL SELECT 'type', event_type FROM events UNION ALL SELECT 'value', CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) FROM events
  UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d') FROM events UNION ALL SELECT 'us', strftime(ts, '%m/%d/%Y') FROM events UNION ALL SELECT 'flag', CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'n/a' END FROM events"""


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the event log as strings, one row a cell, from a single scan."""
    e = table(spark, sf_dir, "events")
    cells = {
        "props": F.get_json_object("props", "$.k"),
        "type": F.col("event_type"),
        "value": F.col("value").cast("decimal(18,2)").cast("string"),
        "day": F.date_format("ts", "yyyy-MM-dd"),
        "us": F.date_format("ts", "MM/dd/yyyy"),
        "flag": F.when(F.col("user_id") % 2 == 0, "True").otherwise("n/a"),
    }
    return e.select(F.explode(F.array(*[F.struct(F.lit(k).alias("col"), v.alias("v")) for k, v in cells.items()])).alias("c")).select("c.col", "c.v")


@query(
    f"""WITH c AS ({CELLS}), t AS (SELECT col, CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'null', 'none', 'na', 'n/a', 'nan') THEN 'null' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '[+-]?\\d+') THEN 'integer'
       WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float' WHEN regexp_full_match(v, '\\d{{4}}-\\d\\d?-\\d\\d?|\\d\\d?/\\d\\d?/\\d{{4}}') THEN 'datetime' ELSE 'string' END AS inferred FROM c)
       SELECT col, inferred, count(*) AS n FROM t GROUP BY ALL"""
)
def infer_scalar_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = event_cells(spark, sf_dir).select("col", T.scalar_type(F.col("v")).alias("inferred"))
    return typed.groupBy("col", "inferred").agg(F.count("*").alias("n"))


@query("SELECT a.vec_id, b.vec_id AS query_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 5) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0) b")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the stated query set (ids divisible by 100)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return dense.all_cosines(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS before, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first_unit, 1.0::DOUBLE AS after FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    u = e.withColumn("u", T.l2_normalize(F.col("e")))
    return u.select("vec_id", F.round(T.norm(F.col("e")), 5).alias("before"), F.round(F.get("u", F.lit(0)), 5).alias("first_unit"), F.round(T.norm(F.col("u")), 5).alias("after"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 <> 0), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label) SELECT label, CAST(i AS INTEGER) AS dimension, round(m / norm, 6) AS value FROM m JOIN n USING (label)")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for the tokens of a text (their label); every fifth is masked. All components of the unit mean."""
    e = table(spark, sf_dir, "embeddings").select("label", "embedding", (F.col("vec_id") % 5 != 0).alias("mask"))
    pooled = embedding.mean_pool(e, "label")
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).alias("dimension"), F.round("x", 6).alias("value"))


@query(
    """WITH r AS (SELECT doc_id, list_transform(range(0, 16), lambda i: CAST(('0x' || substr(sha256(text), CAST((i * 7) % 32 * 2 + 1 AS BIGINT), 2)) AS INTEGER) / CAST(127.5 AS DOUBLE) - 1) AS v FROM documents)
       SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS last FROM r"""
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", T.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"))


@query("SELECT doc_id, '[Source: ' || source || CASE WHEN n_chars > 1000 THEN ', Page: ' || (doc_id % 7 + 1) ELSE '' END || CASE WHEN lang = 'en' THEN ', Section: Introduction' ELSE '' END || ']' AS citation FROM documents")
def format_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, heading = F.when(F.col("n_chars") > 1000, F.col("doc_id") % 7 + 1), F.when(F.col("lang") == "en", "Introduction")
    return table(spark, sf_dir, "documents").select("doc_id", T.citation(F.col("source"), page, heading).alias("citation"))


@query(
    """SELECT conv_id, turn, regexp_matches(lower(text), '\\b(sum|total|average|avg|count|min|max|minimum|maximum|mean|highest|lowest|revenue|profit|loss|sales|price|cost|amount|quantity|budget|volume)\\b')
       OR (regexp_matches(lower(text), '\\b(greater than|less than|more than|at least|at most|above|below|between|exceeding)\\b|[><=]') AND regexp_matches(text, '[$€£₹]|\\b\\d+(\\.\\d+)?\\b|\\b[qQ][1-4]\\b')) AS quantitative FROM conversations"""
)
def is_quantitative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_quantitative(F.col("text")).alias("quantitative"))


@query(
    """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(q, 'summary|summarize|overview|main topics|what is this document about|table of contents') THEN 'summary'
       WHEN regexp_matches(q, 'author|auther|authur|who wrote|poet|poetess|writer|writter') THEN 'author_lookup' WHEN regexp_matches(q, 'who is|who was|character|protagonist') THEN 'character_lookup' ELSE 'fact_lookup' END AS intent
       FROM (SELECT *, lower(text || CASE conv_id % 4 WHEN 0 THEN ' overview' WHEN 1 THEN ' who was it' WHEN 2 THEN ' its writter' ELSE '' END) AS q FROM conversations)"""
)
def detect_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent of every message; a suffix by conversation makes all intents occur."""
    suffix = F.when(F.col("conv_id") % 4 == 0, " overview").when(F.col("conv_id") % 4 == 1, " who was it").when(F.col("conv_id") % 4 == 2, " its writter").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent_of(F.concat("text", suffix)).alias("intent"))


ASK = "(?i)^(who|what|why|how|where|when|is|are|was|were|do|does|did|can|could|would|should)\\s"


@query(
    f"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\\s’]+', ' ', 'g')) AS t FROM conversations),
       a AS (SELECT *, CASE conv_id % 6 WHEN 0 THEN 'What is ' || t WHEN 1 THEN 'What is the author of ' || t WHEN 2 THEN t || ' summary' WHEN 3 THEN 'Who is Dr. Jane Smith' WHEN 4 THEN 'Grumble Family' ELSE 'What is the author of the book' END AS q,
       CASE conv_id % 6 WHEN 0 THEN 'wat is -> what is' WHEN 1 THEN 'auther -> author; formulated natural author question' WHEN 2 THEN 'sumery -> summary' WHEN 3 THEN 'resolved malformed possessive entity' WHEN 4 THEN 'resolved malformed possessive entity' ELSE 'normalized informal author query' END AS changes,
       regexp_matches(t, '(?i)^(who|what)\\s') AS asks FROM c),
       b AS (SELECT conv_id, turn, regexp_replace(CASE WHEN conv_id % 6 = 1 AND asks THEN upper(t[1]) || substr(t, 2) || ' author' ELSE q END, '[?.!\\s]+$', '') AS q, CASE WHEN conv_id % 6 = 1 AND asks THEN 'auther -> author' ELSE changes END AS changes FROM a)
       SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)^(who|what|why|how|where|when|tell me|explain)\\s') THEN upper(q[1]) || substr(q, 2) ELSE q END || CASE WHEN regexp_matches(q, '{ASK}') THEN '?' ELSE '' END AS standardized, changes FROM b"""
)
def standardize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a spelling mistake, a possessive or an author phrase each (by conversation), repaired and tidied."""
    k, text = F.col("conv_id") % 6, F.trim(F.regexp_replace("text", r"[\s’]+", " "))
    raw = (
        F.when(k == 0, F.concat(F.lit("wat is "), text)).when(k == 1, F.concat(text, F.lit(" auther name?"))).when(k == 2, F.concat(text, F.lit(" sumery ? ")))
        .when(k == 3, F.lit("Dr. Jane Smith's?")).when(k == 4, F.lit("Grumble Family's")).otherwise(F.lit("author of the book?"))
    )
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.standardized(raw).alias("s"))
    return s.select("conv_id", "turn", F.col("s.query").alias("standardized"), F.concat_ws("; ", "s.changes").alias("changes"))


@query(
    """WITH p AS (SELECT a.conv_id, a.turn, a.text AS raw, CASE WHEN a.turn % 4 = 1 THEN 'Who is ' || b.text ELSE b.text END AS re FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
       w AS (SELECT *, list_filter(regexp_extract_all(lower(raw), '[a-z0-9]+'), lambda x: len(x) > 3) AS ws, lower(re) AS low FROM p)
       SELECT conv_id, turn, len(re) >= 2 AND NOT regexp_matches(low, 'the answer is|according to|in this story|is a renowned|was born in')
       AND NOT (regexp_matches(low, '^who (is|was) ') AND NOT contains(lower(raw), 'who') AND NOT regexp_matches(lower(raw), '\\b(dr\\.?|doctor|mr\\.?|mrs\\.?|ms\\.?|prof\\.?|professor)\\b'))
       AND (len(ws) = 0 OR len(list_filter(ws, lambda x: contains(low, x) OR contains(low, substr(x, 1, 4)))) > 0) AS valid FROM w"""
)
def validate_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next message of a conversation would be a valid rewrite of this one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    rewritten = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Who is "), "next")).otherwise(F.col("next"))
    return c.join(later, ["conv_id", "turn"]).select("conv_id", "turn", T.rewrite_is_valid(F.col("text"), rewritten).alias("valid"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)\\b(rag|source|version|page|build|chunk)=\"[^\"]*\"', '', 'g'), '<[^>]+>', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\s+([,.!?])', '\\1', 'g'), ' ' || chr(10) || chr(9))) AS clean_sha256 FROM pages")
def sanitize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("[chk_a_b-1]"), "html", F.lit(" [Source: x]"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.sanitize_answer(marked), 256).alias("clean_sha256"))


@query("SELECT doc_id, len(s) AS n_sentences, s[1] AS first_sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


FACT = """coalesce(list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: len(s) BETWEEN 30 AND 180 AND right(s, 1) <> '?' AND left(s, 1) <> '#')[1],
  trim(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len(x) >= 20)[1], 1, 140)), trim(substr(text, 1, 100), ' ' || chr(10)))"""


@query(f"SELECT doc_id, {FACT} AS fact FROM documents")
def extract_declarative_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.declarative_fact(F.col("text")).alias("fact"))


@query("SELECT conv_id, turn, CASE WHEN len(t) > 50 THEN substr(t, 1, 48) || '...' ELSE t END AS title FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS t FROM conversations)")
def conversation_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), "text", F.lit('"'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.title_of(quoted).alias("title"))


@query("""SELECT source, sha256('{"chunk_overlap":64,"chunk_size":' || (256 + len(source) * 32) || ',"source":"' || source || '","top_k":5}') AS config_hash FROM (SELECT DISTINCT source FROM documents)""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a configuration as compact JSON with its keys in order."""
    config = table(spark, sf_dir, "documents").select("source").distinct().select("source", (F.length("source") * 32 + 256).alias("chunk_size"), F.lit(64).alias("chunk_overlap"), F.lit(5).alias("top_k"))
    return config.select("source", T.canonical_hash(*config.columns).alias("config_hash"))


@query(
    "WITH r AS (SELECT 'part' AS sheet, p_partkey AS k, 'p_name p_brand' AS head, 'p_name: ' || p_name || ' p_brand: ' || p_brand AS line FROM part UNION ALL SELECT 'customer', c_custkey, 'c_name c_mktsegment', 'c_name: ' || c_name || ' c_mktsegment: ' || c_mktsegment FROM customer), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY k) AS n FROM r) SELECT sheet, sheet || ' ' || head || ' ' || string_agg(line, ' ' ORDER BY k) AS text FROM n WHERE n <= 10 GROUP BY sheet, head"
)
def dataset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of a dataset as texts for the analyzer: name, column names and the values of its first ten rows."""
    part = profile.dataset_text(table(spark, sf_dir, "part"), "part", ["p_name", "p_brand"], "p_partkey")
    return part.unionByName(profile.dataset_text(table(spark, sf_dir, "customer"), "customer", ["c_name", "c_mktsegment"], "c_custkey"))
