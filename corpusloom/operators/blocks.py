"""Documents to blocks: rows of (source_id, block_index, type, level, content, page_number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def line_blocks(docs: DataFrame, key: str = "doc_id", per_page: int = 40) -> DataFrame:
    """Every line with a character as a paragraph block; ``per_page`` blocks make a page."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("block_index", "raw"))
    b = lines.select(key, "block_index", T.strip(F.col("raw")).alias("content")).where("content <> ''")
    page = (F.floor(F.col("block_index") / per_page) + 1).cast("int")
    return b.select(key, "block_index", F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "content", page.alias("page_number"))


def _cased(text: Column) -> Column:
    """Upper case throughout, or every word's first letter upper and the rest lower case."""
    letters = text.rlike(r"\p{L}")
    return letters & ((F.upper(text) == text) | ~text.rlike(r"(?<!\p{L})\p{Ll}|\p{L}\p{Lu}"))


def is_heading(text: Column, max_words: int = 8, ends: str = ".:;") -> Column:
    """A short line without a closing mark whose words are all capitalized."""
    return (T.word_count(text) <= max_words) & ~text.rlike(f"[{ends}]$") & ~text.contains("\n") & _cased(text)


def text_blocks(docs: DataFrame, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """Plain text cut at ``separator``: headings (level 2) or paragraphs with their offset in the text.

    Offsets count all earlier parts, blank ones too. They are summed inside the row, so no window shuffles the text.
    """
    step = len(separator)
    parts = docs.select(key, F.split("text", separator).alias("p"))
    at = F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    offsets = parts.select(key, F.aggregate(at, F.expr("named_struct('next', 0L, 'out', cast(array() as array<struct<i:int,x:string,off:bigint>>))"), lambda s, e: F.struct((s["next"] + F.length(e["x"]) + step).alias("next"), F.concat(s["out"], F.array(F.struct(e["i"].alias("i"), e["x"].alias("x"), s["next"].alias("off")))).alias("out")))["out"].alias("b"))
    blocks = offsets.select(key, F.explode("b").alias("b")).select(key, F.col("b.i").alias("part"), T.strip(F.col("b.x")).alias("content"), F.col("b.off").alias("char_offset")).where("content <> ''")
    heading = is_heading(F.col("content"))
    return blocks.select(key, "part", F.when(heading, "heading").otherwise("paragraph").alias("type"), F.when(heading, 2).alias("level"), "content", "char_offset")


def page_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of pages (key, page_number, line_no, line): headings stay alone, other lines of a stretch are joined by spaces.

    A stretch is a run between headings of one page (gaps and islands), so grouping is by document, page and stretch.
    """
    heading = is_heading(F.col("line"), 12, ".:;,")
    marked = lines.withColumn("h", heading)
    w = Window.partitionBy(key, "page_number").orderBy("line_no")
    stretch = marked.withColumn("g", F.sum(F.when(F.col("h") | F.coalesce(F.lag("h").over(w), F.lit(True)), 1).otherwise(0)).over(w))
    joined = stretch.groupBy(key, "page_number", "g").agg(F.max("h").alias("h"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return joined.select(key, "page_number", F.col("g").alias("block"), F.when(F.col("h"), "heading").otherwise("paragraph").alias("type"), F.concat_ws(" ", F.transform("ls", lambda x: x["line"])).alias("content"))


def markdown_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markdown lines (key, line_no, line) to blocks: fences, pipe tables, headings, quotes, list items and paragraphs.

    Fence parity is a running count over the document's lines; blocks are islands of lines of one kind.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*```")
    f = lines.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("fence", fence)
    inside = F.col("fence") | (F.col("fences") % 2 == 1)
    low = F.trim("line")
    kind = (
        F.when(inside, "code")
        .when(low == "", "blank")
        .when(low.rlike(r"^#{1,6}\s"), "heading")
        .when(low.startswith("|"), "table")
        .when(low.startswith(">"), "quote")
        .when(low.rlike(r"^([-*+]|\d+\.)\s"), "list_item")
        .otherwise("paragraph")
    )
    k = f.withColumn("kind", kind)
    before = F.lag("kind").over(order)
    starts = (F.coalesce(before, F.lit("")) != F.col("kind")) | F.col("kind").isin("heading", "list_item") | (F.col("fence") & (F.col("fences") % 2 == 1))
    islands = k.withColumn("g", F.sum(starts.cast("int")).over(order)).where((F.col("kind") != "blank") & ~F.col("fence"))
    g = islands.groupBy(key, "g").agg(F.first("kind").alias("type"), F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    text = F.transform("ls", lambda x: x["line"])
    content = (
        F.when(F.col("type") == "paragraph", F.concat_ws(" ", F.transform(text, lambda x: F.trim(x))))
        .when(F.col("type") == "heading", F.regexp_replace(F.trim(F.get(text, F.lit(0))), r"^#{1,6}\s+", ""))
        .when(F.col("type") == "quote", F.concat_ws(" ", F.transform(text, lambda x: F.trim(F.regexp_replace(x, r"^\s*>\s?", "")))))
        .when(F.col("type") == "list_item", F.regexp_replace(F.trim(F.get(text, F.lit(0))), r"^([-*+]|\d+\.)\s+", ""))
        .otherwise(F.concat_ws("\n", text))
    )
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract(F.trim(F.get(text, F.lit(0))), r"^(#{1,6})\s", 1)))
    return g.select(key, "line_no", "type", level.alias("level"), content.alias("content"))
