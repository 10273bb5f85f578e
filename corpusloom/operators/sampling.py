"""Samples: of a document's blocks, of a table's rows, of chunks for probes, and windows of conversations.

Rows are picked by position or by seeded hash order, so a sample is the same on any cluster. Positions of an unbounded group
come from a range partition and the counts of its parts (:func:`numbered`), never from one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import stored

#: Bounds of a document's sample.
HEADINGS, TABLES, MAX_TOKENS, MIDDLE_CHARS, TAIL_CHARS = 50, 2, 4_000, 1_500, 1_000


def _tokens(text: Column) -> Column:
    """Estimated tokens without a floor: 1.33 a word, cut to a whole number."""
    return F.floor(T.word_count(text) * F.lit(1.33)).cast("int")


def document_sample(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, outline, head, middle, tail, tables and tokens of documents with a block array ``bs``.

    Up to six blocks all are head; else the first three, two around the middle and the last two. Page breaks do not count.
    The outline is cut to 50 headings and tables to two; over 4,000 tokens the middle and the tail are trimmed.
    """
    content = F.filter("bs", lambda b: b["type"] != "page_break")
    of = lambda kind: F.filter("bs", lambda b: b["type"] == kind)
    texts = lambda blocks: F.transform(blocks, lambda b: b["content"])
    d = docs.select(key, texts(content).alias("c"), F.transform(of("heading"), lambda b: F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(2))), F.lit(" "), b["content"])).alias("headings"), F.slice(texts(of("table")), 1, TABLES).alias("tables"))
    n, small = F.size("c"), F.size("c") <= 6
    none = F.slice("c", 1, 0)
    d = d.withColumns({"h": F.when(small, F.col("c")).otherwise(F.slice("c", 1, 3)), "m": F.when(small, none).otherwise(F.slice("c", F.floor(n / 2).cast("int"), F.lit(2))), "t": F.when(small, none).otherwise(F.slice("c", n - 1, F.lit(2)))})
    joined = lambda c: F.when(F.size(c) > 0, F.concat_ws("\n\n", c))
    d = d.withColumn("tokens", _tokens(F.concat_ws("\n", "headings", "h", "m", "t", "tables"))).select(key, "headings", "tables", joined("h").alias("head"), joined("m").alias("middle"), joined("t").alias("tail"), "tokens")
    over = F.col("tokens") > MAX_TOKENS
    d = d.withColumns({"middle": F.when(over, F.substring("middle", 1, MIDDLE_CHARS)).otherwise(F.col("middle")), "tail": F.when(over, F.substring("tail", 1, TAIL_CHARS)).otherwise(F.col("tail"))})
    trimmed = _tokens(F.concat_ws("\n", "headings", F.coalesce("head", F.lit("")), F.coalesce("middle", F.lit("")), F.coalesce("tail", F.lit(""))))
    return d.select(key, F.slice("headings", 1, HEADINGS).alias("outline"), "head", "middle", "tail", "tables", F.when(over, trimmed).otherwise(F.col("tokens")).alias("tokens"))


def seeded(seed: int, key: str) -> Column:
    """A random but repeatable order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def dataset_sample(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(part, at, key): the first 10 rows by key, 10 seeded ones from between, and the last 5.

    Of up to 15 rows nothing is drawn, of up to 20 from all rows; of up to 10 there is no last part. Every part is a bounded
    top-k, the count is one aggregate.
    """
    ids = rows.select(F.col(key))
    total = ids.agg(F.count("*").alias("total"))
    place = lambda df, order: df.withColumn("at", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  of at most 15 rows
    first = place(ids.orderBy(key).limit(10), [key]).withColumn("part", F.lit("first"))
    last = place(ids.orderBy(F.desc(key)).limit(5), [key]).withColumn("part", F.lit("last")).crossJoin(total).where("total > 10").drop("total")
    ends = first.select(key).unionAll(ids.orderBy(F.desc(key)).limit(5)).withColumn("_end", F.lit(True))
    pool = ids.join(F.broadcast(ends.distinct()), key, "left").crossJoin(total).where("total > 15 AND (total <= 20 OR _end IS NULL)")
    drawn = place(pool.select(key, seeded(seed, key).alias("_h")).orderBy("_h", key).limit(10), ["_h", key]).select(key, "at", F.lit("sampled").alias("part"))
    return first.unionByName(drawn).unionByName(last).select("part", "at", key)


def cap_samples(samples: DataFrame, sheet: str, caps: dict[str, int]) -> DataFrame:
    """The samples of several sheets (sheet, part, at, ...), each part cut to its cap over all sheets in order."""
    w = Window.partitionBy("part").orderBy(sheet, "at")
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most[F.col("part")]).drop("_r")


def numbered(df: DataFrame, group: str, order: str, name: str = "position") -> DataFrame:
    """``df`` with the position of each row in its group, from 0 in order. Large groups spread over many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, order).sortWithinPartitions(group, order)
    local = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    parts = local.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_g", "_p", (before - F.col("_first")).alias("_shift"))  # a row a group and part
    return local.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_g", "_p", "_shift")


def systematic(chunks: DataFrame, group: str, order: str, count: int = 6) -> DataFrame:
    """min(count, n) chunks of each group at equal steps from its first one: positions i * max(1, n div min(count, n))."""
    at = numbered(chunks, group, order)
    totals = at.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_total"))
    few = F.least(F.lit(count), F.col("_total"))
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / few))
    joined = at.join(totals, F.col(group).eqNullSafe(F.col("_group")))
    return joined.where((F.col("position") % step == 0) & (F.col("position") / step < few)).drop("_group", "_total")


def widen_hits(hits: DataFrame, chunks: DataFrame, group: str, key: str, at_most: int = 10, score: float = 0.01) -> DataFrame:
    """Hits (group, rank, key, score) followed by a systematic sample of the group's chunks that were not hit, with a low
    score; at most so many in all, ranked anew. The caller deduplicates the result as any hit list."""
    drawn = systematic(chunks.select(group, key), group, key).join(hits.select(group, key), [group, key], "left_anti")
    both = hits.select(group, key, F.col("score").cast("double").alias("score"), F.lit(0).alias("_kind"), F.col("rank").cast("long").alias("_order"))
    both = both.unionByName(drawn.join(hits.select(group).distinct(), group, "left_semi").select(group, key, F.lit(score).alias("score"), F.lit(1).alias("_kind"), F.col("position").alias("_order")))
    w = Window.partitionBy(group).orderBy("_kind", "_order")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= at_most).drop("_kind", "_order")


def stratified(chunks: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """(group, key, turn): the first n turns of a round-robin over the groups in seeded order; a group that has run out
    loses its turn, and there are no more turns than chunks. Only n chunks a group survive the window."""
    d = chunks.select(group, key)
    order = d.select(group).distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(group))))) - 1)
    total = d.agg(F.count_distinct(group).alias("s"), F.count("*").alias("total"))
    rounds = d.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("round") <= n)
    turns = rounds.join(order, group).crossJoin(F.broadcast(total)).withColumn("turn", (F.col("round") - 1) * F.col("s") + F.col("pos"))
    return turns.where("turn < total").orderBy("turn").limit(n).select(group, key, "turn")


def history_window(messages: DataFrame, n: int = 8, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_snippets(chunks: DataFrame, group: str, key: str, n: int = 5, chars: int = 280, text: str = "text") -> DataFrame:
    """(group, key, snippet) of the first n chunks of each group. The snippet is cut before the shuffle, so texts do not move."""
    snippet = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(F.col(text))
    d = chunks.select(group, key, snippet.alias("snippet"))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_n") <= n).drop("_n")
