"""Benchmark decontamination: pigeonhole edit matching over words, verified with Myers bit-parallel distance.

Texts are lower-cased and cut into words. A test item of n words may be found with up to k = floor(n * rate) word edits
(insertions, deletions, substitutions). It is split into k + 1 pieces; whatever k edits do, one piece stays exact.
Exact piece hits come from one multi-pattern automaton run over the document; every hit is verified around its place
with the bit-parallel edit distance of Myers, in which one machine word per item holds a column of the table.

The benchmark side is the small side and is checked: items are broadcast in blocks of about ``block_bytes`` of text
each, and a larger benchmark is met by more passes over the documents, block by block, never by a bigger broadcast; what a
pass gives is stored, so a task holds one automaton. The document side streams through a narrow stage: no shuffle, so hot
passages and large groups of copies are harmless.

Null or empty texts and items match nothing, and items without an id are left out. Items of one id are in one block; they
are matched as separate items and reported under their id once a document (the smallest distance, all places). Ties between
places go to the first one. Under 1 / EDIT_RATE words an item has no edit budget and is found as it stands;
:func:`decontaminate` drops no document for items under MIN_WORDS words, which any text may hold by chance. Rows that repeat a
doc_id are judged one by one. An empty table on either side gives no find and drops nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import filter_documents, stored
from corpusloom.shipping import ready

WORD = re.compile(r"[^\W_]+")
#: Share of an item's words that may be edited, and the bytes of item text in one broadcast.
EDIT_RATE, BLOCK_BYTES = 0.15, 8 << 20
#: Words of an item for which a document may go.
MIN_WORDS = 5
FOUND = "doc_id long, item_id long, distance long, n_places long, first_end long, last_end long"

_matchers: dict[str, Matcher] = {}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def budget(n_words: int, rate: float = EDIT_RATE) -> int:
    return int(n_words * rate)


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 spans that cover n words as evenly as can be."""
    cuts = [round(i * n / (k + 1)) for i in range(k + 2)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: list[str], text: list[str], k: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern in text with at most k edits; the first of equals."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for at, w in enumerate(text):
        match = eq.get(w, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = (minus | ~((match | down) | plus)) & full
        down = plus & (match | down)
        if score <= k and (best is None or score < best[0]):
            best = (score, at)
    return best


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_words: int = 1) -> None:
        self.items: list[tuple[int, list[str], int]] = []
        self.automaton = ahocorasick.Automaton()
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) < max(1, min_words):
                continue
            k = budget(len(words), rate)
            for a, b in pieces(len(words), k):
                key = " " + " ".join(words[a:b]) + " "
                self.automaton.get(key, None) or self.automaton.add_word(key, (len(key), []))
                self.automaton.get(key)[1].append((len(self.items), a))
            self.items.append((item_id, words, k))
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """item_id -> verified places as (end word, distance, first word of the window)."""
        if not self.items:
            return {}
        words = words_of(text)
        line = " " + " ".join(words) + " "
        found: dict[int, list[tuple[int, int, int]]] = {}
        seen: set[tuple[int, int]] = set()
        last_char, n_words = 0, 0
        for end, (length, uses) in self.automaton.iter(line):
            start = end - length + 1  # char of the space before the piece
            if start >= last_char:
                n_words += line.count(" ", last_char, start)
            else:
                n_words -= line.count(" ", start, last_char)
            last_char = start
            for item, offset in uses:
                begin = n_words - offset  # where the item starts if nothing was inserted or deleted before the piece
                if (item, begin) in seen:
                    continue
                seen.add((item, begin))
                item_id, pattern, k = self.items[item]
                low, high = max(0, begin - k), begin + len(pattern) + k
                hit = myers(pattern, words[low:high], k)
                if hit:
                    found.setdefault(item_id, []).append((low + hit[1], hit[0], low))
        return found


def _matcher(name: str, items, rate: float, min_words: int = 1) -> Matcher:
    """The matcher of a broadcast block, built once a Python worker; the one before it is let go."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items.value, rate, min_words)
    return _matchers[name]


def _blocks(spark: SparkSession, items: DataFrame, item_key: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``; the total is measured first and decides how many there are."""
    named = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL")
    total = named.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("b")).first()["b"]
    n = -(-total // block_bytes) or 1
    for block in range(n):
        mine = named if n == 1 else named.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block)
        yield [(r["item_id"], r["item"]) for r in mine.collect()]


def find_items(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row for each document and item that it holds: the least distance, the number of places, first and last end word."""
    spark = ready(docs.sparkSession)
    out = None
    for block in _blocks(spark, items, item_key, item_text, block_bytes):
        part = _find_block(docs, spark.sparkContext.broadcast(block), rate, text)
        out = part if out is None else stored(out.unionAll(part), "found-items")
    return out


def _find_block(docs: DataFrame, some, rate: float, text: str) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, some, rate)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, t in zip(b.column(0), b.column(1), strict=True):
                for item_id, places in matcher.find(t.as_py()).items():
                    ends = sorted({e for e, _, _ in places})
                    rows.append((doc_id.as_py(), item_id, min(d for _, d, _ in places), len(ends), ends[0], ends[-1]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "n_places", "first_end", "last_end"])

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that hold no test item of ``min_words`` words or more, all columns as they came.

    The verdict is made where the document is, so nothing is joined back and rows that repeat a doc_id are judged one by one.
    """
    spark = ready(docs.sparkSession)
    clean = docs
    for k, block in enumerate(_blocks(spark, items, "item_id", "text", block_bytes)):
        some, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def keep(texts: list, some=some, name=name) -> list:
            matcher = _matcher(name, some, rate, min_words)
            return [not matcher.find(t) for t in texts]

        clean = filter_documents(stored(clean, "clean-so-far") if k else clean, keep)
    return clean
