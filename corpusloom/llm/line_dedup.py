"""Line deduplication through a deletion-neighbourhood join, in DataFrame functions only.

A line is its words (runs of non-space characters). Two lines are near when one word edit (insertion, deletion or
substitution) at most turns one into the other. A line is repeated when an equal or a near line stands earlier, in
(doc_id, line number) order; the earliest line of every class therefore stays, and what is dropped does not depend on
the order of work.

Plan. (1) Texts are read once: a table of line hashes in the shared folder serves all later steps. (2) Equal lines: one
aggregation by a 128-bit hash with map-side combine gives each distinct line its first place; a line that fills a third
of the corpus is one row after that. (3) Few distinct lines have a near partner, so before any neighbourhood is built a
pigeonhole test on the distinct lines alone keeps those that share their first or last half with another (one edit
leaves one half whole): only counts are compared, never pairs. (4) The lines kept fetch their words once and emit every
variant with one word deleted, in the half that need not be whole, as a hashed key. Lines with the same rest at the same
position are a substitution apart; a line equal to another's rest lacks one word of it. Per key only the earliest member
is aggregated, so a crowded key gives one row; joins are equi-joins that the engine may split. (5) Each link is verified
by its edit distance.

Every line with a word is dropped as an exact repeat; lines under ``near_words`` words only as such, since one word is a
large part of them. Lines under ``min_words`` words are never dropped. Null text: the document has no lines. A row with a
null doc_id has no place, so its lines neither go nor make others go. Rows that repeat a doc_id have the same line places, so
they never drop each other's lines; a line that goes in one of them goes in all. Other columns may have any name. An
empty table gives no repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

MIN_WORDS, NEAR_WORDS = 1, 5


def _norm(line: Column) -> Column:
    """Single spaces between words; lines that have them already are not touched."""
    uneven = line.startswith(" ") | line.endswith(" ")
    for part in ("  ", "\t", "\r", "\x0b", "\x0c"):
        uneven = uneven | line.contains(part)
    return F.when(uneven, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def lines_of(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line (single spaces) and n_words of every line with enough words."""
    cut = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    named = cut.select("doc_id", "line_no", _norm(F.col("raw")).alias("line"))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    counted = named.withColumn("n_words", F.when(F.col("line") == "", 0).otherwise(spaces + 1))
    return counted.where(F.col("n_words") >= min_words)


def _halves() -> Column:
    """Keys under which a near partner of a line is met: its first and its last half, for its own and the shorter length."""
    keys = []
    for n in ("n_words", "n_words - 1"):
        keys.append(f"xxhash64({n}, 'first', substring_index(line, ' ', cast(({n}) div 2 as int)))")
        keys.append(f"xxhash64({n}, 'last', substring_index(line, ' ', cast(({n}) div 2 - ({n}) as int)))")
    return F.expr(f"array({', '.join(keys)})")


def _near_lines(docs: DataFrame, distinct: DataFrame, text: str) -> DataFrame:
    """place (doc_id, line_no, h1), words, low, high of the distinct lines that share a half with another one.

    An edit that leaves the shared half whole lies at a word from ``low`` to before ``high``.
    """
    keyed = distinct.where("halves IS NOT NULL").select("h1", "h2", "first", "n_words", F.posexplode("halves").alias("which", "half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    n = F.col("n_words") - F.floor(F.col("which") / 2)  # the length whose halves these are
    low = F.when(F.col("which") % 2 == 0, F.floor(n / 2)).otherwise(0)
    high = F.when(F.col("which") % 2 == 0, F.col("n_words")).otherwise(F.col("n_words") - n + F.floor(n / 2))
    some = keyed.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min(low).cast("int").alias("low"), F.max(high).cast("int").alias("high"))
    wanted = some.groupBy(F.col("first.doc_id").alias("id")).agg(F.collect_list(F.struct("first.line_no", "h1", "low", "high")).alias("wanted"))
    with_text = wanted.join(docs.select(F.col("doc_id").alias("id"), F.col(text).alias("_text")), "id")
    raw = with_text.select("id", "wanted", F.split("_text", "\n").alias("raws"))
    each = raw.select(F.col("id").alias("doc_id"), F.explode(F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get("raws", w["line_no"]).alias("raw")))).alias("l"))
    line = each.select(F.struct("doc_id", "l.w.line_no", "l.w.h1").alias("place"), "l.w.low", "l.w.high", _norm(F.col("l.raw")).alias("line")).where(F.xxhash64("line") == F.col("place.h1"))
    return line.select("place", "low", "high", F.split("line", " ").alias("words")).dropDuplicates(["place"])


def _one_edit(a: str, b: str) -> Column:
    """Whether at most one word edit turns the words of a into those of b."""
    without = lambda w: f"exists(sequence(0, size({w}) - 1), i -> concat(slice({w}, 1, i), slice({w}, i + 2, size({w}))) = OTHER)"
    return F.expr(
        f"CASE size({a}) - size({b}) "
        f"WHEN 0 THEN aggregate(zip_with({a}, {b}, (x, y) -> CASE WHEN x = y THEN 0 ELSE 1 END), 0, (s, x) -> s + x) <= 1 "
        f"WHEN 1 THEN {without(a).replace('OTHER', b)} WHEN -1 THEN {without(b).replace('OTHER', a)} ELSE false END"
    )


def _near_links(near: DataFrame) -> DataFrame:
    """place of a line and the place (of) of the earliest near line before it. Variants meet by 128 bits of hash."""
    rests = F.expr("transform(sequence(low, high - 1), i -> transform(array(concat_ws(' ', slice(words, 1, i), slice(words, i + 2, size(words)))), r -> struct(i AS at, xxhash64(r) AS rest, xxhash64('second', r) AS rest2))[0])")
    variants = stored(near.where("high > low").select("place", F.explode(rests).alias("v")).select("place", "v.at", "v.rest", "v.rest2"), "line-variants")
    line = F.concat_ws(" ", "words")
    whole = near.select(F.xxhash64(line).alias("rest"), F.xxhash64(F.lit("second"), line).alias("rest2"), F.col("place").alias("short"))
    firsts = variants.groupBy("rest", "rest2", "at").agg(F.min("place").alias("of"), F.count("*").alias("n")).where("n > 1").select("rest", "rest2", "at", "of")
    swapped = variants.join(firsts, ["rest", "rest2", "at"]).where("of < place").select("place", "of")
    meets = variants.select("rest", "rest2", F.col("place").alias("long")).join(whole, ["rest", "rest2"])
    added = meets.where("short < long").select(F.col("long").alias("place"), F.col("short").alias("of"))
    lacking = meets.where("long < short").select(F.col("short").alias("place"), F.col("long").alias("of"))
    return swapped.unionAll(added).unionAll(lacking).groupBy("place").agg(F.min("of").alias("of"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, text: str = "text") -> DataFrame:
    """doc_id, line_no, kind ('exact' or 'near'), of_doc_id, of_line: every line that repeats an earlier one.

    For an exact repeat the place is that of its first equal line, for the rest that of the earliest near line.
    """
    return _repeated(docs, min_words, near_words, text).drop("h1").distinct()


def _repeated(docs: DataFrame, min_words: int, near_words: int, text: str) -> DataFrame:
    """As :func:`repeated_lines` with the line's hash, which tells lines apart where rows share a doc_id."""
    lines = lines_of(docs, min_words, text)
    hashed = stored(lines.select("doc_id", "line_no", "n_words", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.when(F.col("n_words") >= near_words, _halves()).alias("halves")), "line-hashes")
    place = F.struct("doc_id", "line_no")
    distinct = stored(hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("n_words").alias("n_words"), F.any_value("halves").alias("halves")), "distinct-lines")
    near = stored(_near_lines(docs, distinct, text), "near-lines")
    words = near.select(F.col("place").alias("p"), "words")
    pairs = _near_links(near).join(words, F.col("place") == F.col("p")).select("place", "of", "words").join(words.withColumnsRenamed({"p": "q", "words": "of_words"}), F.col("of") == F.col("q"))
    verified = pairs.where(_one_edit("words", "of_words")).select("place", F.struct(F.col("of.doc_id").alias("doc_id"), F.col("of.line_no").alias("line_no")).alias("near_of"))
    same = (F.col("h1") == F.col("place.h1")) & (F.col("first.doc_id") == F.col("place.doc_id")) & (F.col("first.line_no") == F.col("place.line_no"))
    classes = distinct.join(verified, same, "left").where("n > 1 OR near_of IS NOT NULL").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first", "near_of")
    at = hashed.select("doc_id", "line_no", "h1", "h2").join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    later = F.col("first") < place
    found = at.where(later | F.col("near_of").isNotNull())
    of = F.when(later, F.col("first")).otherwise(F.col("near_of"))
    return found.select("doc_id", "line_no", "h1", F.when(later, "exact").otherwise("near").alias("kind"), of["doc_id"].alias("of_doc_id"), of["line_no"].alias("of_line"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with their repeated lines taken out, all columns kept (n_chars follows the text if it is there).

    A document that loses every line with a word is dropped; one that had none, or lost none, stays as it was. Rows that share
    a doc_id are told apart by their lines: a line goes from a row only if it is the line that repeats.
    """
    named = lambda i, h: F.concat_ws(":", i.cast("string"), h.cast("string"))
    found = _repeated(docs, min_words, near_words, "text").select(F.col("doc_id").alias("id"), named(F.col("line_no"), F.col("h1")).alias("line"))
    gone = found.groupBy("id").agg(F.collect_set("line").alias("gone"))
    joined = docs.select(F.struct(*docs.columns).alias("row")).join(gone, F.col("row.doc_id") == F.col("id"), "left")
    every = F.transform(F.split(F.col("row.text"), "\n"), lambda x, i: named(i, F.xxhash64(_norm(x))))
    keep = F.transform(F.array_except(every, "gone"), lambda k: F.substring_index(k, ":", 1).cast("int"))
    joined = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), keep).alias("keep"))
    cut = F.expr("transform(array(split(row.text, '\\n')), ls -> array_join(transform(keep, i -> ls[i]), '\\n'))[0]")
    same = F.col("gone").isNull() | (F.size("keep") == F.size(F.split(F.col("row.text"), "\n")))
    kept = joined.select("row", same.alias("same"), F.when(same, F.col("row.text")).otherwise(cut).alias("left")).where("same OR left RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("same"), F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
