"""Queries of profiles and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import profile, recommend
from corpusloom.plans.chunk_queries import LINES, MARKED, marked_documents
from corpusloom.plans.registry import query, table

KIND = "CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'null', 'none', 'na', 'n/a', 'nan') THEN 'null' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '[+-]?\\d+') THEN 'integer' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float' WHEN regexp_full_match(v, '\\d{4}-\\d\\d?-\\d\\d?') THEN 'datetime' ELSE 'string' END"
TAIL = ", coalesce((SELECT string_agg(v, ', ' ORDER BY pos) FROM (SELECT v, pos FROM k z WHERE z.col = k.col AND kind <> 'null' ORDER BY pos LIMIT 5)), NULL) AS samples"
NUM = "CASE WHEN kind = 'boolean' THEN CAST(lower(v) = 'true' AS INTEGER) WHEN kind IN ('integer', 'float') THEN CAST(v AS DOUBLE) END"


def profiled(cells: str, kind: str, numbers: str = NUM) -> str:
    return (
        f"WITH c AS ({cells}), k AS (SELECT *, {KIND} AS kind FROM c), x AS (SELECT *, {numbers} AS x FROM k), "
        "f AS (SELECT col, string_agg(v, ', ' ORDER BY pos) AS samples, first(kind ORDER BY pos) AS fk FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY pos) AS r FROM k WHERE kind <> 'null') WHERE r <= 5 GROUP BY col), "
        "n AS (SELECT col, count(*) FILTER (kind = 'boolean') AS b, count(*) FILTER (kind = 'integer') AS i, count(*) FILTER (kind = 'float') AS f, count(*) FILTER (kind IN ('string', 'datetime')) AS s, "
        "count(*) FILTER (kind = 'null') AS null_count, count(DISTINCT v) FILTER (kind <> 'null') AS distinct_count, CAST(min(x) AS DOUBLE) AS min_value, CAST(max(x) AS DOUBLE) AS max_value, round(avg(x), 2) AS mean_value FROM x GROUP BY col) "
        f"SELECT col AS \"column\", {kind} AS inferred_type, null_count, distinct_count, samples, min_value, max_value, mean_value FROM n LEFT JOIN f USING (col)"
    )


def cells_sql(t: str, key: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {key} AS pos, {e} AS v FROM {t}" for c, e in columns.items())


DOMINANT = "CASE WHEN greatest(b, i, f, s) = 0 THEN 'string' WHEN i = greatest(b, i, f, s) THEN 'integer' WHEN f = greatest(b, i, f, s) THEN 'float' WHEN b = greatest(b, i, f, s) THEN 'boolean' ELSE 'string' END"
EVENT = {"user": "CAST(user_id AS VARCHAR)", "amount": "CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR)", "kind": "event_type", "flag": "CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END", "day": "strftime(ts, '%Y-%m-%d')"}


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "false")
    return e.select("event_id", F.col("user_id").alias("user"), F.col("value").cast("decimal(18,2)").alias("amount"), F.col("event_type").alias("kind"), flag.alias("flag"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(profiled(cells_sql("events", "event_id", EVENT), DOMINANT))
def column_profile_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(profile.long_cells(event_rows(spark, sf_dir), list(EVENT), F.col("event_id")))


@query(profiled(cells_sql("events", "event_id", {k: EVENT[k] for k in ("user", "kind", "flag")} | {"k": "json_extract_string(props, '$.k')"}), "CASE WHEN fk IN ('integer', 'float', 'boolean') THEN fk ELSE 'string' END", NUM.replace("CASE WHEN kind = 'boolean' THEN CAST(lower(v) = 'true' AS INTEGER) WHEN", "CASE WHEN")))
def column_profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "event_id")
    return profile.column_profile(profile.long_cells(rows, ["user", "kind", "flag", "k"], F.col("event_id")), "json")


PART = {"p_name": "p_name", "p_size": "CAST(p_size AS VARCHAR)", "price": "CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR)", "mixed": "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'true' END"}


@query(profiled(cells_sql("part", "p_partkey", PART), "CASE WHEN b + i + f + s = 0 THEN 'string' WHEN i = b + i + f + s THEN 'integer' WHEN i + f = b + i + f + s THEN 'float' WHEN b > 0 THEN 'boolean' ELSE 'string' END"))
def column_profile_spreadsheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("decimal(18,2)").alias("price"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("true").alias("mixed"))
    return profile.column_profile(profile.long_cells(rows, list(PART), F.col("p_partkey")), "spreadsheet")


@query(profiled(cells_sql("customer", "c_custkey", {"c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS VARCHAR)", "c_mktsegment": "c_mktsegment"}), "'string'", "CAST(NULL AS DOUBLE)"))
def column_profile_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(profile.long_cells(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"], F.col("c_custkey")), "text")


STRUCT = f"WITH {LINES}, {MARKED}, st AS (SELECT doc_id, CAST(least(5, coalesce(max(level), 0)) AS INTEGER) AS heading_depth, count(DISTINCT level) >= 2 OR coalesce(max(level), 0) >= 2 AS hierarchical, CAST(0 AS BIGINT) AS table_count, CAST(0.0 AS DOUBLE) AS tabular_ratio, CAST(sum(len(regexp_extract_all(content, '\\S+'))) AS BIGINT) AS total_words, max(page_number) AS page_count FROM mk GROUP BY doc_id)"


@query(f"{STRUCT} SELECT * FROM st")
def structural_facts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.document_structure(marked_documents(spark, sf_dir))


SHEETS = ["region", "nation", "customer", "supplier", "part"]


SHEET_FACTS = "sf AS (" + " UNION ALL ".join(f"SELECT '{t}' AS sheet, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS cols" for t in SHEETS) + "), sw AS (SELECT sheet, rows, cols, true AS has_numerical, cols * 2 + least(rows, 500) * cols AS word_estimate FROM sf)"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sheet_facts({t: table(spark, sf_dir, t) for t in SHEETS})


@query(f"WITH {SHEET_FACTS} SELECT * FROM sw")
def structural_facts_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of a dataset: rows, columns and an estimate of words."""
    return sheets(spark, sf_dir)


@query(f"WITH {SHEET_FACTS} SELECT count(*) AS total_sheets, CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(cols) AS BIGINT) AS total_columns, bool_or(has_numerical) AS has_numerical, CAST(sum(word_estimate) AS BIGINT) AS total_words FROM sw")
def structural_facts_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_facts(sheets(spark, sf_dir))


@query("WITH n AS (SELECT 'region' AS s, 1 AS o UNION ALL SELECT 'nation', 2), c AS (SELECT s, o, 0 AS p, s AS name FROM n UNION ALL SELECT 'region', 1, row_number() OVER (), column_name FROM (DESCRIBE region) UNION ALL SELECT 'nation', 2, row_number() OVER (), column_name FROM (DESCRIBE nation)), d AS (SELECT name, min(o * 100 + p) AS place FROM c GROUP BY name) SELECT string_agg(name, ',' ORDER BY place) AS entities FROM (SELECT * FROM d ORDER BY place LIMIT 8)")
def key_entities_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two sheets and their columns, as the entities of a dataset."""
    rows = None
    for i, t in enumerate(("region", "nation")):
        df = table(spark, sf_dir, t)
        one = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), F.struct(F.lit(t).alias("sheet"), F.array(*map(F.lit, df.columns)).alias("columns")).alias("s"))
        rows = one if rows is None else rows.unionAll(one)
    listed = rows.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sheets"))
    return listed.select(F.concat_ws(",", profile.dataset_entities(F.col("sheets"))).alias("entities"))


# RE2 has no look-around: words next to a letter, digit or underscore of another script are removed by splitting there.
WS = "list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: lower(w)), lambda w: regexp_full_match(w, '[a-z]{2,}'))"
OBS = f"ws AS (SELECT doc_id, source, text, {WS} AS ws FROM documents)"


@query(f"WITH {OBS} SELECT doc_id, CASE WHEN len(ws) = 0 THEN 'medium' WHEN len(list_distinct(ws)) / CAST(len(ws) AS DOUBLE) > 0.65 OR list_sum(list_transform(ws, lambda w: len(w))) / CAST(len(ws) AS DOUBLE) > 6.5 THEN 'high' WHEN len(list_distinct(ws)) / CAST(len(ws) AS DOUBLE) < 0.35 THEN 'low' ELSE 'medium' END AS density FROM ws")
def vocab_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", profile.words(F.col("text")).alias("ws"))
    return d.select("doc_id", profile.density_of(F.col("ws")).alias("density"))


CYCLE = ["revenue and tax and code", "the patient of the hospital", "a clause of an agreement", "software api", "student course", "nothing here"]


@query("WITH t AS (SELECT doc_id, ['revenue and tax and code', 'the patient of the hospital', 'a clause of an agreement', 'software api', 'student course', 'nothing here'][doc_id % 6 + 1] AS x FROM documents) SELECT doc_id, ['finance', 'healthcare', 'legal', 'technology', 'education', 'general'][doc_id % 6 + 1] AS domain FROM t")
def detect_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain of every text with a phrase added by id, so that all domains occur."""
    phrase = F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", profile.domain_of(profile.words(F.concat_ws(" ", "text", phrase))).alias("domain"))


@query(f"WITH {OBS} SELECT doc_id, CASE WHEN len(list_intersect(ws[1:100], ['der', 'die', 'das', 'und', 'ist'])) > 0 THEN 'de' WHEN len(list_intersect(ws[1:100], ['el', 'la', 'los', 'las', 'es', 'en'])) > 0 THEN 'es' WHEN len(list_intersect(ws[1:100], ['le', 'la', 'les', 'et', 'est'])) > 0 THEN 'fr' ELSE 'en' END AS language FROM ws")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", profile.language_of(profile.words(F.col("text"))).alias("language"))


@query()
def language_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-hit rule and the counting rule against the language column: documents and matches of each."""
    d = table(spark, sf_dir, "documents").select("lang", profile.words(F.col("text")).alias("ws"))
    r = d.select("lang", profile.language_of(F.col("ws")).alias("first"), profile.language_by_count(F.col("ws")).alias("counted"))
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("lang")).alias("first_hits"), F.count_if(F.col("counted") == F.col("lang")).alias("count_hits"))


ENT = "list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9]{2,}') AND lower(w) NOT IN ('the', 'this', 'and', 'for', 'with', 'from'))"
FIRSTS = f"en AS (SELECT doc_id, source, entity, r FROM (SELECT doc_id, source, e AS entity, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT doc_id, source, e, min(p) AS p FROM (SELECT doc_id, source, unnest({ENT}) AS e, generate_subscripts({ENT}, 1) AS p FROM documents) GROUP BY ALL)) WHERE r <= 8)"


@query(f"WITH {FIRSTS} SELECT doc_id, count(entity) AS n, coalesce(string_agg(entity, ',' ORDER BY r), '') AS entities FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN en USING (doc_id) GROUP BY doc_id")
def key_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("doc_id", profile.entities_of(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").cast("long").alias("n"), F.concat_ws(",", "e").alias("entities"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure and observations of every document, in its own row. Some documents are given as tables with numbers, as
    decks or as nested data, by id, so that all kinds occur; text and structure come from one scan."""
    k = F.col("doc_id")
    d = profile.document_structure(marked_documents_with(spark, sf_dir), extra=["source", "text"])
    d = d.withColumn("hierarchical", F.col("hierarchical") & (k % 3 != 1)).withColumn("heading_depth", F.when(k % 3 == 1, F.least(F.lit(1), F.col("heading_depth"))).otherwise(F.col("heading_depth")))
    d = d.withColumns({"tabular_ratio": F.when(k % 7 == 0, 1.0).otherwise(F.col("tabular_ratio")), "fmt": F.when(k % 13 == 5, "json").otherwise("txt"), "slide_count": F.when(k % 11 == 3, k % 5).otherwise(0), "total_rows": k % 4, "numeric": k % 2 == 0})
    e = profile.entities_of(F.col("text"))
    d = d.withColumns({"modality": profile.modality_of(F.col("text"), k % 7 == 0, F.col("fmt"), F.col("slide_count")), "domain": profile.domain_of(profile.words(F.col("text"))), "entities": e})
    return d.withColumns({"entity_density": profile.entity_density(F.size("entities"), F.col("numeric")), "quality": profile.extraction_quality(k % 6)}).drop("text")


def marked_documents_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block arrays with the source and the text of their document."""
    from corpusloom.operators import chunking
    from corpusloom.plans.chunk_queries import marked_line

    d = table(spark, sf_dir, "documents")
    return chunking.line_documents(d, mark=marked_line, extra=["source", "text"])


MOD = (
    f"{STRUCT}, {FIRSTS}, ne AS (SELECT doc_id, count(*) AS n FROM en GROUP BY ALL), o1 AS (SELECT doc_id, source, text, total_words, page_count, table_count, doc_id % 4 AS total_rows, doc_id % 2 = 0 AS numeric, CASE WHEN doc_id % 11 = 3 THEN doc_id % 5 ELSE 0 END AS slide_count, CASE WHEN doc_id % 3 = 1 THEN least(1, heading_depth) ELSE heading_depth END AS heading_depth, hierarchical AND doc_id % 3 <> 1 AS hierarchical, coalesce(n, 0) AS n FROM st JOIN documents USING (doc_id) LEFT JOIN ne USING (doc_id)), "
    "ob AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'tabular_dataset' WHEN slide_count > 0 THEN 'slide_presentation' WHEN hierarchical OR heading_depth >= 2 THEN 'hierarchical_document' WHEN doc_id % 13 = 5 THEN 'semi_structured_code' WHEN regexp_matches(lower(text), 'abstract|methodology|references|doi:|bibliography') THEN 'scientific_research' ELSE 'narrative_text' END AS modality, "
    "CASE WHEN doc_id % 7 = 0 AND numeric AND n >= 4 THEN 'high' WHEN doc_id % 7 = 0 THEN 'medium' WHEN hierarchical AND n >= 5 THEN 'medium' ELSE 'low' END AS entity_density, CAST(round(greatest(0.6, 1.0 - 0.1 * (doc_id % 6)), 2) AS DOUBLE) AS quality FROM o1)"
)


@query(f"{MOD} SELECT doc_id, modality, entity_density, quality FROM ob")
def classify_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("doc_id", "modality", "entity_density", "quality")


LIKE = "e AS (SELECT doc_id, coalesce(' such as ' || string_agg(entity, ', ' ORDER BY r), '') AS such FROM (SELECT doc_id, e AS entity, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) AS r FROM (SELECT doc_id, unnest({0}) AS e, generate_subscripts({0}, 1) AS p FROM documents) GROUP BY doc_id, e) WHERE r <= 3 GROUP BY doc_id)"


@query(
    f"{MOD}, {LIKE.format(ENT)} SELECT doc_id, CASE modality WHEN 'tabular_dataset' THEN 'This general dataset contains structured records and metrics' || coalesce(such, '') || '. It is organized into ' || table_count || ' sheet(s) with defined column schemas.' "
    "WHEN 'hierarchical_document' THEN 'This general document contains hierarchical sections and headings' || coalesce(such, '') || '. It describes operational standards across ' || page_count || ' pages.' "
    "WHEN 'slide_presentation' THEN 'This presentation contains structured slide content concerning general topics' || coalesce(such, '') || '. Information is formatted into bullet points and section headers.' "
    "ELSE 'This document contains narrative text focused on general topics' || coalesce(such, '') || '. It presents descriptive information in sequential paragraphs.' END AS summary, "
    "CASE modality WHEN 'tabular_dataset' THEN 'Structured dataset with ' || table_count || ' table sheet(s) and ' || CASE WHEN total_rows = 0 THEN 'multiple' ELSE CAST(total_rows AS VARCHAR) END || ' rows.' || CASE WHEN numeric THEN '|Contains numerical quantitative attributes suitable for aggregation.' ELSE '' END "
    "WHEN 'hierarchical_document' THEN 'Hierarchical section structure with heading depth ' || heading_depth || '.|Contains ' || total_words || ' words across narrative paragraphs.' WHEN 'slide_presentation' THEN 'Slide deck presentation with ' || slide_count || ' distinct slides.' "
    "ELSE 'Narrative document text with approx ' || total_words || ' words.' END || '|Content reflects General domain terminology and structure.' AS characteristics FROM ob LEFT JOIN e USING (doc_id)"
)
def describe_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observed(spark, sf_dir)
    m, d = F.col("modality"), F.col("domain")
    return o.select("doc_id", profile.summary_of(m, d, F.col("entities")).alias("summary"), F.concat_ws("|", profile.characteristics_of(m, d, F.col("numeric"))).alias("characteristics"))


def share(modality: str) -> str:
    return f"coalesce((SELECT round(n / CAST(total AS DOUBLE), 4) FROM mc WHERE mc.source = tt.source AND modality = '{modality}'), 0.0)"


PROFILE = (
    f"{MOD}, mc AS (SELECT source, modality, count(*) AS n, min(doc_id) AS f FROM ob GROUP BY ALL), tt AS (SELECT source, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds FROM mc GROUP BY ALL), pr AS (SELECT source, total AS n_files, (SELECT modality FROM mc WHERE mc.source = tt.source ORDER BY n DESC, f LIMIT 1) AS dominant, kinds = 1 AS homogeneous, "
    f"{share('tabular_dataset')} AS tabular, {share('hierarchical_document')} AS hierarchical, {share('scientific_research')} AS research, {share('narrative_text')} AS narrative, (SELECT max(heading_depth) FROM ob WHERE ob.source = tt.source) AS depth FROM tt)"
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.corpus_profile(observed(spark, sf_dir).select("source", "doc_id", "modality", "domain", "heading_depth")).withColumn("dense_research", F.lit(False))


@query(f"{PROFILE} SELECT source, n_files, dominant, homogeneous, tabular, hierarchical, narrative, research, CAST(depth AS INTEGER) AS depth, 'general' AS domain FROM pr")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir)
    part = lambda m: F.coalesce(F.col("shares")[m], F.lit(0.0))
    return p.select("source", "n_files", "dominant", "homogeneous", part("tabular_dataset").alias("tabular"), part("hierarchical_document").alias("hierarchical"), part("narrative_text").alias("narrative"), part("scientific_research").alias("research"), "depth", "domain")


@query(f"WITH {FIRSTS.replace('SELECT doc_id, source, entity FROM', 'SELECT doc_id, source, entity, r FROM')} SELECT source, lower(entity) AS key, count(*) AS n, arg_max(entity, doc_id * 100 + r) AS entity FROM en GROUP BY ALL HAVING count(*) >= 2")
def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(profile.entities_of(F.col("text"))).alias("pos", "entity"))
    return profile.shared_entities(e)


CONDITIONS = {
    "mixed_modality": "narrative + hierarchical + research > 0.2 AND tabular > 0.2",
    "tabular_dominant": "tabular >= 0.7",
    "scientific_research": "dominant = 'scientific_research' OR research >= 0.5",
    "hierarchical_longform": "(dominant = 'hierarchical_document' OR hierarchical >= 0.5) AND depth >= 2",
    "default_document": "true",
}
#: Profiles at the borders of the rules: the share of tables of each source moves with its number.
SHIFTED = "pr2 AS (SELECT source, n_files, dominant, homogeneous, round(CAST(substr(source, 4) AS INTEGER) * 0.05, 2) AS tabular, hierarchical, research, narrative, depth FROM pr)"
MATCHED = ", mr AS (" + " UNION ALL ".join(f"SELECT source, '{r}' AS rule, '{a}' AS architecture, CAST({c} AS DOUBLE) AS confidence, CAST({p} AS INTEGER) AS priority FROM pr2 WHERE {CONDITIONS[r]}" for r, (a, c, p) in recommend.RULES.items()) + ")"


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.round(F.substring("source", 4, 9).cast("int") * 0.05, 2)
    return profiles(spark, sf_dir).withColumn("shares", F.map_concat(F.map_filter("shares", lambda k, v: k != "tabular_dataset"), F.create_map(F.lit("tabular_dataset"), share)))


@query(f"{PROFILE}, {SHIFTED}{MATCHED} SELECT * FROM mr")
def recommendation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that matches a corpus."""
    return recommend.matched_rules(shifted(spark, sf_dir))


@query(f"{PROFILE}, {SHIFTED}{MATCHED}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, priority DESC) AS r FROM mr) SELECT source, rule, CAST(r AS INTEGER) AS rank FROM rk")
def rank_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.ranked_hits(recommend.matched_rules(shifted(spark, sf_dir)), "source").select("source", "rule", "rank")


@query(f"{PROFILE}, {SHIFTED}{MATCHED}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, priority DESC) AS r FROM mr), w AS (SELECT * FROM rk WHERE r = 1), al AS (SELECT source, list_concat(list(architecture ORDER BY r), ['document_rag', 'hierarchical_rag', 'hybrid_rag', 'structured_rag', 'research_rag', 'graph_rag']) AS a FROM rk GROUP BY ALL) SELECT source, rule, architecture, confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level, array_to_string(list_transform(list_sort(list_transform(list_distinct(a), lambda x: struct_pack(p := list_position(a, x), x := x)))[2:], lambda s: s.x), ',') AS alternatives FROM w JOIN al USING (source)")
def recommend_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recommend.recommend(shifted(spark, sf_dir))
    return r.select("source", "rule", "architecture", "confidence", "level", F.concat_ws(",", "alternatives").alias("alternatives"))
