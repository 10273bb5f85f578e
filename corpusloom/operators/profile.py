"""Profiles: columns of tables, structure and language of documents, and the summary of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import stored

#: Key words of the domains, in order; on equal overlap the first domain counts.
DOMAINS = {
    "finance": "revenue profit budget quarter sales fiscal tax financial margin cost attainment".split(),
    "legal": "agreement party parties terms liability dispute clause jurisdiction regulation statute".split(),
    "technology": "software system api architecture database module microservices code server python".split(),
    "healthcare": "patient clinical medical treatment diagnosis health hospital physician".split(),
    "education": "course student curriculum lecture assignment university faculty".split(),
}
#: A language's function words, in the order in which languages are tried.
LANGUAGES = {"de": "der die das und ist".split(), "es": "el la los las es en".split(), "fr": "le la les et est".split()}
#: Marks of research texts, words that are no entities, and formats of nested data.
ACADEMIC = ["abstract", "methodology", "references", "doi:", "bibliography"]
PLAIN_OPENERS = ["the", "this", "and", "for", "with", "from"]
NESTED_FORMATS = ["json", "xml"]
#: What is said of a source, by modality; {} are filled in order. The last entry is for all other modalities.
CHARACTERISTICS = {
    "tabular_dataset": ("Structured dataset with {} table sheet(s) and {} rows.", ["table_count", "total_rows"]),
    "hierarchical_document": ("Hierarchical section structure with heading depth {}.", ["heading_depth"]),
    "slide_presentation": ("Slide deck presentation with {} distinct slides.", ["slide_count"]),
    "other": ("Narrative document text with approx {} words.", ["total_words"]),
}
NUMERIC_NOTE = "Contains numerical quantitative attributes suitable for aggregation."
PARAGRAPH_NOTE = "Contains {} words across narrative paragraphs."
DOMAIN_NOTE = "Content reflects {} domain terminology and structure."
SUMMARIES = {
    "tabular_dataset": ("This {} dataset contains structured records and metrics{}. It is organized into {} sheet(s) with defined column schemas.", "table_count"),
    "hierarchical_document": ("This {} document contains hierarchical sections and headings{}. It describes operational standards across {} pages.", "page_count"),
    "slide_presentation": ("This presentation contains structured slide content concerning {} topics{}. Information is formatted into bullet points and section headers.", None),
    "other": ("This document contains narrative text focused on {} topics{}. It presents descriptive information in sequential paragraphs.", None),
}


def long_cells(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """(column, pos, v) of every cell as a string, from one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    return rows.select(order.alias("pos"), F.explode(cells).alias("c")).select("c.column", "pos", "c.v")


def _numbers(kind: Column, v: Column) -> Column:
    """A cell's number: true and false count as 1 and 0."""
    return F.when(kind == "boolean", (F.lower(v) == "true").cast("double")).when(kind.isin("integer", "float"), F.expr("try_cast(v as double)"))


def column_profile(cells: DataFrame, rule: str = "delimited") -> DataFrame:
    """One row a column: type, nulls, distinct values, first five values, least, largest and mean number.

    ``rule`` decides the type: 'delimited' takes the most frequent one (datetime counts as string), 'spreadsheet' an
    integer only if all are, a float if all are numbers, a boolean if any is, 'text' always string, 'json' that of the
    first value and leaves booleans out of the numbers. One aggregation by (column, value) with map-side combine comes
    first, so distinct counts and the types of hot values cost one row each.
    """
    typed = cells.withColumn("kind", T.scalar_type(F.col("v")))
    values = typed.groupBy("column", "v", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    known = F.col("kind") != "null"
    number = F.when(F.col("kind") == "boolean", F.lit(None)).otherwise(_numbers(F.col("kind"), F.col("v"))) if rule == "json" else _numbers(F.col("kind"), F.col("v"))
    values = values.withColumn("x", number)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    g = values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.when(known, 1)).alias("distinct_count"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.round(F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), 2).alias("mean_value"),
        *[count(k).alias(k) for k in ("boolean", "integer", "float", "datetime", "string")],
        F.min_by("kind", F.when(known, F.col("first"))).alias("first_kind"),
    )
    text = F.col("string") + F.col("datetime")
    top = F.greatest("boolean", "integer", "float", text)
    some = F.col("boolean") + F.col("integer") + F.col("float") + text
    kinds = {
        "delimited": F.when(top == 0, "string").when(F.col("integer") == top, "integer").when(F.col("float") == top, "float").when(F.col("boolean") == top, "boolean").otherwise("string"),
        "spreadsheet": F.when(some == 0, "string").when(F.col("integer") == some, "integer").when(F.col("integer") + F.col("float") == some, "float").when(F.col("boolean") > 0, "boolean").otherwise("string"),
        "text": F.lit("string"),
        "json": F.when(F.col("first_kind").isin("integer", "float", "boolean"), F.col("first_kind")).otherwise("string"),
    }
    samples = typed.where(known).withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("pos"))).where("r <= 5")
    listed = samples.groupBy("column").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"])).alias("samples"))
    out = g.join(F.broadcast(listed), "column", "left").select("column", kinds[rule].alias("inferred_type"), "null_count", "distinct_count", "samples", "min_value", "max_value", "mean_value")
    return out.withColumns({c: F.lit(None).cast("double") for c in ("min_value", "max_value", "mean_value")}) if rule == "text" else out


def structure(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: heading depth (0 to 5), whether it is hierarchical, tables, share of tables, words, pages."""
    level = F.when(F.col("type") == "heading", F.coalesce("level", F.lit(1)))
    g = blocks.groupBy(key).agg(
        F.least(F.lit(5), F.coalesce(F.max(level), F.lit(0))).alias("heading_depth"),
        F.count_distinct(level).alias("levels"),
        F.count_if(F.col("type") == "table").alias("table_count"),
        F.count("*").alias("n_blocks"),
        F.sum(T.word_count(F.col("content"))).alias("total_words"),
        F.max("page_number").alias("page_count"),
    )
    return g.select(key, "heading_depth", ((F.col("levels") >= 2) | (F.col("heading_depth") >= 2)).alias("hierarchical"), "table_count", F.round(F.col("table_count") / F.col("n_blocks"), 4).alias("tabular_ratio"), "total_words", "page_count")


def document_structure(docs: DataFrame, key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """The same of documents with a block array ``bs``, in their rows: nothing is shuffled. ``extra`` columns are kept."""
    level = F.transform(F.filter("bs", lambda b: b["type"] == "heading"), lambda b: F.coalesce(b["level"], F.lit(1)))
    tables = F.size(F.filter("bs", lambda b: b["type"] == "table")).cast("long")
    d = docs.select(key, *(extra or []), "bs", F.least(F.lit(5), F.coalesce(F.array_max(level), F.lit(0))).alias("heading_depth"), F.size(F.array_distinct(level)).alias("levels"), tables.alias("table_count"))
    n_words = F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + T.word_count(b["content"]))
    return d.select(key, *(extra or []), "heading_depth", ((F.col("levels") >= 2) | (F.col("heading_depth") >= 2)).alias("hierarchical"), "table_count", F.round(F.col("table_count") / F.size("bs"), 4).alias("tabular_ratio"), n_words.alias("total_words"), F.array_max(F.transform("bs", lambda b: b["page_number"])).alias("page_count"))


def words(text: Column) -> Column:
    """Lower-cased words of two or more ASCII letters that stand alone."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{2,}(?![\p{L}\p{N}_])"), F.lit(0)), F.lower)


def domain_of(ws: Column) -> Column:
    def best(w: Column) -> Column:
        scored = F.array(*[F.struct(F.size(F.array_intersect(w, F.array(*map(F.lit, kw)))).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("d")) for i, (d, kw) in enumerate(DOMAINS.items())])
        return F.array_max(scored)

    return T.let(T.let(F.array_distinct(ws), best), lambda b: F.when(b["n"] > 0, b["d"]).otherwise("general"))


def density_of(ws: Column) -> Column:
    def density(w: Column) -> Column:
        share = F.try_divide(F.size(F.array_distinct(w)), F.size(w))
        length = F.try_divide(F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)), F.size(w))
        return F.when(F.size(w) == 0, "medium").when((share > 0.65) | (length > 6.5), "high").when(share < 0.35, "low").otherwise("medium")

    return T.let(ws, density)


def language_of(ws: Column) -> Column:
    """The first language with a function word among the first 100 words; else en."""
    head, out = F.slice(ws, 1, 100), F.lit("en")
    for lang, stop in reversed(LANGUAGES.items()):
        out = F.when(F.arrays_overlap(head, F.array(*map(F.lit, stop))), lang).otherwise(out)
    return out


def language_by_count(ws: Column) -> Column:
    """The language with the most function words in the whole text; ties in the order tried, none: en."""
    english = "the of and to in that is was for it".split()

    def hits(stop: list[str]) -> Column:
        return F.size(F.filter(ws, lambda w: w.isin(stop)))

    scored = F.array(*[F.struct(hits(stop).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("l")) for i, (lang, stop) in enumerate({"en": english, **LANGUAGES}.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["l"]).otherwise("en")


def entities_of(text: Column, at_most: int = 8) -> Column:
    """Distinct capitalized words in order of appearance, common openers left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z0-9]{2,}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(PLAIN_OPENERS))), 1, at_most)


def dataset_entities(sheets: Column, at_most: int = 8) -> Column:
    """The entities of a dataset: the names of its sheets and columns, once each in order. ``sheets`` is an array of structs
    (sheet, columns)."""
    return F.slice(F.array_distinct(F.flatten(F.transform(sheets, lambda s: F.concat(F.array(s["sheet"]), s["columns"])))), 1, at_most)


def dataset_text(rows: DataFrame, name: str, columns: list[str], key: str, n: int = 10) -> DataFrame:
    """One row (sheet, text): the sheet's name, its columns and the values of its first n rows by key."""
    some = rows.select(key, *columns).orderBy(key).limit(n)
    line = F.concat_ws(" ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns])
    listed = some.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))).alias("rows"))
    return listed.select(F.lit(name).alias("sheet"), F.concat_ws(" ", F.lit(name), *map(F.lit, columns), F.col("rows.line")).alias("text"))


def sheet_facts(sheets: dict[str, DataFrame]) -> DataFrame:
    """One row a sheet: rows, columns, whether a column is numeric, and an estimate of words (two a column name, one a cell of
    up to 500 rows)."""
    out = None
    for name, df in sheets.items():
        numeric = any(t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") for _, t in df.dtypes)
        one = df.agg(F.lit(name).alias("sheet"), F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("cols"), F.lit(numeric).alias("has_numerical"))
        out = one if out is None else out.unionAll(one)
    return out.withColumn("word_estimate", F.col("cols") * 2 + F.least(F.col("rows"), F.lit(500)) * F.col("cols"))


def dataset_facts(sheets: DataFrame) -> DataFrame:
    """One row for all sheets of a dataset, from :func:`sheet_facts`."""
    return sheets.agg(F.count("*").alias("total_sheets"), F.sum("rows").alias("total_rows"), F.sum("cols").alias("total_columns"), F.bool_or("has_numerical").alias("has_numerical"), F.sum("word_estimate").alias("total_words"))


def modality_of(text: Column, dataset: Column | None = None, fmt: Column | None = None, slides: Column | None = None) -> Column:
    """On the columns of :func:`structure`: tabular, slides, hierarchical, nested data, research or narrative, in this order.

    ``dataset`` says that the source is a table, ``fmt`` is its format, ``slides`` the number of its slides.
    """
    none = F.lit(False)
    deck = (F.coalesce(fmt == "pptx", none) if fmt is not None else none) | (F.coalesce(slides > 0, none) if slides is not None else none)
    nested = F.coalesce(fmt.isin(NESTED_FORMATS), none) if fmt is not None else none
    return (
        F.when((F.col("tabular_ratio") >= 0.7) | (dataset if dataset is not None else none), "tabular_dataset")
        .when(deck, "slide_presentation")
        .when(F.col("hierarchical") | (F.col("heading_depth") >= 2), "hierarchical_document")
        .when(nested, "semi_structured_code")
        .when(T.any_of(F.lower(text), ACADEMIC), "scientific_research")
        .otherwise("narrative_text")
    )


def secondary_of(modality: Column) -> Column:
    """tabular_dataset for documents that hold tables, else null."""
    return F.when(modality.isin("hierarchical_document", "scientific_research", "narrative_text") & (F.col("table_count") > 0), "tabular_dataset")


def entity_density(n_entities: Column, numeric: Column | None = None) -> Column:
    tabular = F.col("tabular_ratio") >= 0.7
    return F.when(tabular & (numeric if numeric is not None else F.lit(False)) & (n_entities >= 4), "high").when(tabular, "medium").when(F.col("hierarchical") & (n_entities >= 5), "medium").otherwise("low")


def extraction_quality(n_warnings: Column) -> Column:
    return F.round(F.greatest(F.lit(0.6), F.lit(1.0) - n_warnings * 0.1), 2)


def _filled(template: str, *values: Column) -> Column:
    """The template with its {} replaced by the values."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def _or_multiple(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit(0)).cast("string"), F.lit("multiple"))


def characteristics_of(modality: Column, domain: Column, numeric: Column | None = None) -> Column:
    """What is observed of a source, as an array of sentences. Reads table_count, total_rows, heading_depth, slide_count and
    total_words."""
    said = lambda m: _filled(CHARACTERISTICS[m][0], *[_or_multiple(c) if c in ("total_rows", "slide_count") else F.col(c).cast("string") for c in CHARACTERISTICS[m][1]])
    note = F.when(modality == "hierarchical_document", _filled(PARAGRAPH_NOTE, F.col("total_words").cast("string")))
    note = F.when((modality == "tabular_dataset") & (numeric if numeric is not None else F.lit(False)), NUMERIC_NOTE).otherwise(note)
    first = F.lit(None).cast("string")
    for m in ("tabular_dataset", "hierarchical_document", "slide_presentation"):
        first = F.when(modality == m, said(m)).otherwise(first)
    return F.array_compact(F.array(F.coalesce(first, said("other")), note, _filled(DOMAIN_NOTE, F.initcap(domain))))


def summary_of(modality: Column, domain: Column, entities: Column) -> Column:
    """One or two plain sentences on a source. Reads table_count and page_count."""
    like = F.when(F.size(entities) > 0, F.concat(F.lit(" such as "), F.concat_ws(", ", F.slice(entities, 1, 3)))).otherwise("")

    def said(m: str) -> Column:
        template, column = SUMMARIES[m]
        return _filled(template, domain, like, *([] if column is None else [_or_multiple(column) if column == "page_count" else F.col(column).cast("string")]))

    out = said("other")
    for m in ("tabular_dataset", "hierarchical_document", "slide_presentation"):
        out = F.when(modality == m, said(m)).otherwise(out)
    return out


def corpus_profile(observed: DataFrame, corpus: str = "source", order: str = "doc_id") -> DataFrame:
    """One row a corpus: shares of modalities (4 decimals), the dominant one, homogeneity, most frequent domain, greatest
    heading depth. Of equal counts the one observed first (smallest ``order``) is taken.

    One pass counts by (corpus, modality, domain) with map-side combine; everything after works on those few rows.
    """
    counts = stored(observed.groupBy(corpus, "modality", "domain").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max("heading_depth").alias("depth")), "profile-counts")
    most = lambda kind: F.max(F.struct("n", (-F.col("first")).alias("f"), F.col(kind)))
    m = counts.groupBy(corpus, "modality").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("depth").alias("depth"))
    m = m.groupBy(corpus).agg(F.sum("n").alias("n_files"), most("modality").alias("top"), F.collect_list(F.struct("modality", "n")).alias("ms"), F.max("depth").alias("depth"))
    d = counts.groupBy(corpus, "domain").agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy(corpus).agg(most("domain").alias("d"))
    shares = F.map_from_entries(F.transform("ms", lambda x: F.struct(x["modality"].alias("k"), F.round(x["n"] / F.col("n_files"), 4).alias("v"))))
    return m.join(d, corpus).select(corpus, "n_files", F.col("top.modality").alias("dominant"), shares.alias("shares"), (F.size("ms") == 1).alias("homogeneous"), F.col("d.domain").alias("domain"), "depth")


def shared_entities(entities: DataFrame, corpus: str = "source", order: str = "doc_id") -> DataFrame:
    """Entities (corpus, doc_id, pos, entity) that are named at least twice in a corpus, case ignored; a document names an
    entity once. The last spelling (by document and position) is kept."""
    g = entities.where(F.length(F.trim("entity")) > 2).groupBy(corpus, F.lower(F.trim("entity")).alias("key")).agg(F.count("*").alias("n"), F.max_by("entity", F.struct(order, "pos")).alias("entity"))
    return g.where("n >= 2")
