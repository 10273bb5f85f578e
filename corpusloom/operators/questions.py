"""Suggested questions for a corpus: what its text asks itself, what its sections are about, and general ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: How many chunks are read and questions given; a question in a line and words that rule it out; a section
#: line; the number before a heading; how a section is asked about, by words in it; and what is asked anyway.
CHUNKS, GIVEN = 81, 4
QUESTION = r"([A-Z][^\n\.\?!]{10,85}\?)"
NOT_ASKED = r"(?i)(forgot|sign in|login|password|cookie|click|subscribe|account)"
SECTION = r"^(?:#{1,3}\s+|[0-9]{1,2}\.\s+)([A-Za-z][A-Za-z0-9\s\-_]{3,45})$"
NUMBER = r"^[0-9]+[\.\)]\s*"
PAGE = r"(?i)Page\s+[0-9]+"
ASKED_BY = [
    ("goal|purpose|overview|introduction", "What is the {} of this document?"),
    ("principle|guideline|rule", "Explain the key {}."),
    ("architecture|system|component|pipeline", "What are the key {} components?"),
    ("workflow|how it works|process|step|implementation", "Explain the {} workflow."),
]
ASKED_ELSE = "What does this document explain about {}?"
FALLBACK_NAMED = "What is the main purpose of {}?"
FALLBACKS = ["Explain the key concepts and architecture.", "What are the main implementation steps or workflow?", "Summarize the important sections of this document."]


def _asked(section: Column) -> Column:
    def with_value(template: str, value: Column) -> Column:
        head, tail = template.split("{}")
        return F.concat(F.lit(head), value, F.lit(tail))

    low, out = F.lower(section), with_value(ASKED_ELSE, section)
    for words, template in reversed(ASKED_BY):
        out = F.when(low.rlike(words), with_value(template, low)).otherwise(out)
    return out


def suggest_questions(chunks: DataFrame, names: DataFrame, group: str = "source", key: str = "doc_id") -> DataFrame:
    """(group, question, rank): four different questions for every group of ``names`` (group, name).

    ``chunks`` has group, key, text and heading_path; the first 81 of a group are read. Questions of the text come first, then
    those about section lines, about headings, and general ones that name the group. Only the first chunks of a group leave
    the rank limit, and only lines that match are shuffled after that.
    """
    first = chunks.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("n") <= CHUNKS)
    lines = first.select(group, "n", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select(group, "n", "i", T.strip(F.col("raw")).alias("line"))
    place = F.struct("n", "i")
    quoted = T.strip(F.replace(F.regexp_extract("line", QUESTION, 1), F.lit("\ufffd"), F.lit("'")))
    asked = lines.select(group, place.alias("at"), F.regexp_replace(quoted, r"^([\"'])(.*)\1$", "$2").alias("q")).where(F.col("q") != "")
    asked = asked.where(~F.col("q").rlike(NOT_ASKED) & (T.word_count(F.col("q")) >= 4))
    sections = lines.select(group, F.lit(0).alias("kind"), place.alias("at"), T.strip(F.regexp_extract("line", SECTION, 1)).alias("s"))
    headings = first.select(group, "n", F.posexplode("heading_path").alias("i", "h"))
    plain = T.strip(F.regexp_replace(T.strip(F.regexp_replace("h", NUMBER, "")), r"[\ufffd\?]+", " - "))
    headings = headings.select(group, F.lit(1).alias("kind"), place.alias("at"), plain.alias("s")).where(~F.col("s").rlike(PAGE))
    both = sections.unionByName(headings).where(F.length("s") > 3)
    one = both.groupBy(group, F.lower("s").alias("low")).agg(F.min_by("s", F.struct("kind", "at")).alias("s"), F.min(F.struct("kind", "at")).alias("o"))
    clean = T.strip(F.regexp_replace(F.regexp_replace("s", r"[^\p{L}\p{N}_\s\-/]", " "), r"\s+", " "))
    about = one.select(group, "o", clean.alias("s")).where(F.length("s") >= 3).select(group, _asked(F.col("s")).alias("q"), F.lit(2).alias("p"), F.col("o.kind").alias("kind"), F.col("o.at").alias("at"))
    name = T.strip(F.replace(F.regexp_replace("name", r"\.[a-zA-Z0-9]+$", ""), F.lit("_"), F.lit(" ")))
    named = F.concat(F.lit(FALLBACK_NAMED.split("{}")[0]), F.when(name != "", name).otherwise("this document"), F.lit(FALLBACK_NAMED.split("{}")[1]))
    general = names.select(group, F.posexplode(F.array(named, *map(F.lit, FALLBACKS))).alias("i", "q")).select(group, "q", F.lit(3).alias("p"), F.lit(0).alias("kind"), F.struct(F.lit(0).alias("n"), "i").alias("at"))
    every = asked.select(group, "q", F.lit(1).alias("p"), F.lit(0).alias("kind"), "at").unionByName(about).unionByName(general)
    distinct = every.groupBy(group, "q").agg(F.min(F.struct("p", "kind", "at")).alias("o"))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("o")))
    return ranked.where(F.col("rank") <= GIVEN).select(group, F.col("q").alias("question"), "rank")
