"""Queries of lexical, dense and combined retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, dense, fusion, lexical, profile, segments
from corpusloom.plans.chunk_queries import PART_COLUMNS, part_sheet
from corpusloom.plans.registry import query, table
from corpusloom.storage import stored

K = 5
SECTIONS = ["Abstract", "Introduction", "Methods", "Results", "Discussion", "Conclusion", "References"]

Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TERMS = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS doc_len FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) AS tokens)"
SCORES = (
    "qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')) AS term FROM q) GROUP BY ALL), "
    "bm AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (0.25 + 0.75 * CAST(doc_len AS DOUBLE) / (CAST(tokens AS DOUBLE) / n)))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL HAVING score > 0), "
    "sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"
)
HASHED = "list_transform(range(0, 16), lambda i: CAST(('0x' || substr(sha256({}), CAST((i * 7) % 32 * 2 + 1 AS BIGINT), 2)) AS INTEGER) / CAST(127.5 AS DOUBLE) - 1)"
COS = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"
DENSE_DOCS = f"dv AS (SELECT doc_id, {HASHED.format('text')} AS v FROM documents), qv AS (SELECT query_id, {HASHED.format('query')} AS v FROM q), de AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, {COS} AS score FROM dv a, qv b))"
VEC = f"v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT query_id, vec_id, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id, a.label, {COS} AS score FROM v a, v b WHERE b.vec_id % 50 = 0))"


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query: every benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def document_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    """The stored index of the documents, built by the first query that asks for it."""
    return segments.index_of(table(spark, sf_dir, "documents"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.score(document_index(spark, sf_dir), text_queries(spark, sf_dir))


def bm25_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best documents of every query."""
    return segments.search(document_index(spark, sf_dir), text_queries(spark, sf_dir), k)


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.hash_embedding(F.col("text")).alias("embedding"))


def dense_documents(spark: SparkSession, sf_dir: str, pool: int) -> DataFrame:
    asked = text_queries(spark, sf_dir).select("query_id", T.hash_embedding(F.col("query")).alias("embedding"))
    return dense.dense_topk(document_vectors(spark, sf_dir), asked, pool, "doc_id")


@query(f"WITH {TERMS} SELECT term, df, CAST(sum(tf) AS BIGINT) AS cf, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf, n AS n_docs, tokens AS n_tokens FROM tf JOIN df USING (term), st GROUP BY ALL")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    terms = index.terms.crossJoin(F.broadcast(index.stats()))
    return terms.select("term", "df", "cf", F.round(lexical.idf(F.col("df"), F.col("n_docs")), 6).alias("idf"), "n_docs", "n_tokens")


@query(f"WITH {Q}, {TERMS}, {SCORES} SELECT query_id, doc_id, score FROM bm")
def bm25_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_scores(spark, sf_dir)


@query(f"WITH {Q}, {TERMS}, {SCORES} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, '[Source: ' || source || ']' AS citation FROM sp JOIN documents USING (doc_id) WHERE rank <= {K}")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ranked, cited hits of every query. The last join reads two columns; a few hits are broadcast at run time."""
    hits = bm25_hits(spark, sf_dir, K)
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sources.join(hits, "doc_id").select("query_id", "doc_id", "score", "rank", T.citation(F.col("source"), F.lit(None), F.lit(None)).alias("citation"))


@query(f"WITH {VEC} SELECT query_id, vec_id, score, rank FROM h WHERE rank <= {K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), K)


@query("SELECT count(*) AS n_queries, count(*) * 5 AS n_true, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def dense_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the approximate mode against the exact ones of the same queries: nine of ten are found at least."""
    e, asked = table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir)
    r = dense.recall(dense.approximate_topk(e, asked, K), dense.dense_topk(e, asked, K))
    return r.select("n_queries", "n_true", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(f"WITH {VEC}, p AS (SELECT query_id, vec_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM h WHERE rank <= 4 * {K} AND label < 5) SELECT query_id, vec_id, label, score, CAST(r AS INTEGER) AS rank FROM p WHERE r <= {K}")
def post_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch four times, filter by label, keep the first k that pass."""
    e = table(spark, sf_dir, "embeddings")
    pool = dense.dense_topk(e, vector_queries(spark, sf_dir), 4 * K).join(e.select("vec_id", "label"), "vec_id")
    return fusion.post_filter(pool, K, F.col("label") < 5, "vec_id").select("query_id", "vec_id", "label", "score", "rank")


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT b.vec_id AS query_id, a.vec_id, " + COS + " AS score FROM v a, v b WHERE b.vec_id % 50 = 0 AND a.label < 5), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM h) SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5")
def pre_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact form: the filter goes to the scan, every query gets k hits."""
    return dense.dense_topk(table(spark, sf_dir, "embeddings").where("label < 5"), vector_queries(spark, sf_dir), K)


@query(f"WITH {VEC}, g AS (SELECT query_id, vec_id // 4 * 4 AS target, max(score) AS score, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS children FROM h WHERE rank <= 6 * {K} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS r FROM g) SELECT query_id, target, score, children, CAST(r AS INTEGER) AS rank FROM r WHERE r <= {K}")
def parent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of four consecutive ids share a parent, the first of them."""
    e = table(spark, sf_dir, "embeddings")
    parents = e.select("vec_id", (F.floor(F.col("vec_id") / 4) * 4).alias("parent_id"))
    return fusion.expand_parents(dense.dense_topk(e, vector_queries(spark, sf_dir), 6 * K), parents, K)


@query(f"WITH {Q}, {TERMS}, {SCORES}, {DENSE_DOCS}, f AS (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 6) AS score FROM (SELECT * FROM de WHERE rank <= 30) d FULL JOIN (SELECT * FROM sp WHERE rank <= 30) s USING (query_id, doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM f) SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= {K}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = max(4 * K, 30)
    sparse = bm25_hits(spark, sf_dir, pool)
    return fusion.reciprocal_rank(dense_documents(spark, sf_dir, pool), sparse, K).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {Q}, {TERMS}, {SCORES}, {DENSE_DOCS} SELECT query_id, doc_id, d.rank IS NOT NULL AS dense, s.rank IS NOT NULL AS sparse FROM (SELECT * FROM de WHERE rank <= 20) d FULL JOIN (SELECT * FROM sp WHERE rank <= 20) s USING (query_id, doc_id)")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of either side, once each, with where they came from."""
    return fusion.candidate_union(dense_documents(spark, sf_dir, 20), bm25_hits(spark, sf_dir, 20))


BOOSTED = "bo AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 1.25 WHEN 1 THEN 1.05 WHEN 2 THEN 1.15 WHEN 3 THEN 1.2 WHEN 5 THEN 1.2 ELSE 1.0 END AS boost FROM documents)"


@query(f"WITH {Q}, {TERMS}, {SCORES}, {DENSE_DOCS}, {BOOSTED}, c AS (SELECT query_id, doc_id, coalesce(d.score, 0) AS d, coalesce(s.score, 0) AS b FROM (SELECT * FROM de WHERE rank <= 20) d FULL JOIN sp s USING (query_id, doc_id)), m AS (SELECT query_id, min(b) AS lo, max(b) AS hi FROM c GROUP BY ALL), f AS (SELECT query_id, doc_id, round(CAST(boost AS DOUBLE) * (CAST(0.6 AS DOUBLE) * least(1.0, greatest(0.0, (d + 1) / 2)) + CAST(0.4 AS DOUBLE) * CASE WHEN hi > lo THEN (b - lo) / (hi - lo) ELSE 0.5 END), 4) AS score FROM c JOIN m USING (query_id) JOIN bo USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM f) SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= {K}")
def section_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents take one of seven section headings by id; the BM25 side is not cut."""
    name = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 7 + 1).cast("int"))
    boosts = table(spark, sf_dir, "documents").select("doc_id", T.section_boost(name).alias("boost"))
    hits = fusion.section_rerank(dense_documents(spark, sf_dir, 20), stored(bm25_scores(spark, sf_dir), "scores"), boosts, K)
    return hits.select("query_id", "doc_id", "score", "rank")


@query(f"WITH {Q}, {TERMS}, {SCORES}, m AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM bm GROUP BY ALL) SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END, 5) AS scaled FROM bm JOIN m USING (query_id)")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.minmax(stored(bm25_scores(spark, sf_dir), "scores"), "score").select("query_id", "doc_id", F.round("score_scaled", 5).alias("scaled"))


@query(f"WITH {Q}, {TERMS}, {SCORES}, c AS (SELECT query_id, source AS corpus, doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS cr FROM bm JOIN documents USING (doc_id)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + cr), 6) DESC, score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE cr <= 5) SELECT query_id, corpus, doc_id, CAST(round(1.0 / (60 + cr), 6) AS DOUBLE) AS rrf_score, score AS raw_score, rank FROM r WHERE rank <= 8")
def multi_corpus_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is a corpus of its own."""
    hits = bm25_scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("corpus")), "doc_id")
    return fusion.fuse_corpora(hits, 8).select("query_id", "corpus", "doc_id", "rrf_score", "raw_score", "rank")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT b.vec_id AS query_id, a.vec_id, " + COS + " AS score FROM v a, v b WHERE b.vec_id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM h) SELECT query_id AS vec_id, score, vec_id = query_id AND score >= 0.7 AS consistent FROM r WHERE r = 1")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored vector asked again must find itself first, with cosine 0.7 at least."""
    e = table(spark, sf_dir, "embeddings")
    return dense.self_consistency(e, e.where("vec_id % 10 = 0"))


PARTS = (
    "ch AS (SELECT 'part-' || p_partkey AS chunk_id, 'rows' AS chunk_type, lower(p_name || '; ' || p_brand || '; ' || p_type || '; size ' || p_size) AS low FROM part "
    "UNION ALL SELECT 'part-schema', 'schema', lower('Dataset: part' || chr(10) || 'Sheet: main' || chr(10) || 'Total Rows: ' || count(*) || chr(10) || 'Total Columns: 3' || chr(10) || 'Columns & Types: p_name (string), p_brand (string), p_size (integer)') FROM part)"
)
PQ = "pq AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 200 = 0 THEN 'total size of ' ELSE 'about ' END || p_name || ' ' || p_brand AS query FROM part WHERE p_partkey % 100 = 0)"
MATCH = "m AS (SELECT query_id, chunk_id, round(least(1.0, round(len(list_filter(ws, lambda w: contains(low, w))) / CAST(len(ws) AS DOUBLE), 4) + CASE WHEN chunk_type = 'schema' AND len(list_filter(ws, lambda w: contains(low, w))) > 0 THEN 0.1 ELSE 0 END), 4) AS score FROM (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')) AS ws FROM pq) a, ch), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM m WHERE score > 0)"


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a part and the schema chunk of the sheet."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.col("p_name"), F.lit("; "), F.col("p_brand"), F.lit("; "), F.col("p_type"), F.lit("; size "), F.col("p_size").cast("string"))
    rows = p.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.lit("rows").alias("chunk_type"), text.alias("text"))
    sheet = part_sheet(spark, sf_dir)
    schema = chunking.schema_chunk(sheet, "part", PART_COLUMNS, profile.column_profile(profile.long_cells(sheet, PART_COLUMNS, F.col("position"))))
    return rows.unionByName(schema.select(F.lit("part-schema").alias("chunk_id"), F.lit("schema").alias("chunk_type"), "text"))


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part whose key is divisible by 100 asks for its name and brand, every second one for a total."""
    p = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    return p.select(F.col("p_partkey").alias("query_id"), F.concat(F.when(F.col("p_partkey") % 200 == 0, "total size of ").otherwise("about "), "p_name", F.lit(" "), "p_brand").alias("query"))


@query(f"WITH {PARTS}, {PQ}, {MATCH} SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= {K}")
def structured_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.structured_match(part_queries(spark, sf_dir), part_chunks(spark, sf_dir), K)


@query(
    f"WITH {PARTS}, {PQ}, {MATCH}, cv AS (SELECT chunk_id, {HASHED.format('low')} AS v FROM ch WHERE chunk_type = 'rows'), qv AS (SELECT query_id, {HASHED.format('query')} AS v FROM pq WHERE query NOT LIKE 'total%'), d AS (SELECT query_id, chunk_id, {COS} AS score FROM cv a, qv b), "
    f"dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(substr(chunk_id, 6) AS BIGINT)) AS r FROM d) SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, 'structured_match' AS score_type FROM r WHERE r <= {K} AND query_id % 200 = 0 UNION ALL SELECT query_id, chunk_id, score, 'cosine_similarity' FROM dr WHERE r <= {K}"
)
def structured_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantitative queries match tokens, the others go to the dense list; the split is a column, not a loop."""
    q = part_queries(spark, sf_dir)
    chunks = part_chunks(spark, sf_dir)
    exact = fusion.structured_match(q.where(T.is_quantitative(F.col("query"))), chunks, K).withColumn("score_type", F.lit("structured_match"))
    rows = chunks.where("chunk_type = 'rows'").select(F.expr("try_cast(substring(chunk_id, 6) AS long)").alias("n"), F.lower("text").alias("low"))
    similar = dense.texts_topk(rows, q.where(~T.is_quantitative(F.col("query"))), K, "n", "low", T.hash_embedding)
    similar = similar.select("query_id", F.concat(F.lit("part-"), F.col("n").cast("string")).alias("chunk_id"), "score", F.lit("cosine_similarity").alias("score_type"))
    return exact.select("query_id", "chunk_id", "score", "score_type").unionByName(similar)
