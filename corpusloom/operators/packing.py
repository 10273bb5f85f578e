"""Greedy packing of an ordered table of any size, equal to one fold over it.

A chunk takes rows while their tokens fit; where it ends depends on where it began, and so on back to row 0. But a chunk
holds at most ``size`` rows (a row has a token at least), so it ends within its own span of rows or shortly after: a span
of rows is a small function from where the fold enters it (an offset under ``size``) to where it enters the next, and how many
chunks begin in between. Spans are evaluated in parallel for every possible entry, functions of ``FAN`` consecutive spans are
composed into one, again and again until one is left, and then the entries are handed down the same tree. A task holds a
span, or FAN functions of ``size`` numbers; rounds grow with the logarithm of the table to base FAN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.shipping import ready
from corpusloom.storage import stored

#: Rows of a span (at least ``size``), and functions that are composed by one task.
SPAN, FAN = 4_000, 500


def jumps(tokens: np.ndarray, size: int) -> np.ndarray:
    """For every row the first row that no longer fits into a chunk which begins there; len(tokens) if all do."""
    ends = np.cumsum(tokens)
    return np.maximum(np.searchsorted(ends, ends - tokens + size, "right"), np.arange(len(tokens)) + 1)


def span_function(tokens: np.ndarray, own: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(exit, chunks) for entries 0 to size - 1: where the fold enters the next span, -1 for nowhere, and how many chunks
    begin in this one. ``tokens`` are the span's own rows and those after it, as far as there are any, up to ``size``."""
    to, n = jumps(tokens, size), len(tokens)
    out, count = np.full(max(size, own), -1, np.int64), np.zeros(max(size, own), np.int64)
    for i in range(own - 1, -1, -1):
        t = int(to[i])
        out[i], count[i] = (out[t], count[t] + 1) if t < own else ((t - own if t < n else -1), 1)
    for i in range(own, size):  # a span shorter than that is the last, or no entry leads behind it
        out[i] = -1
    return out[:size], count[:size]


def composed(exits: list[list[int]], counts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at, total = np.arange(len(exits[0])), np.zeros(len(exits[0]), np.int64)
    for out, n in zip(exits, counts, strict=True):
        inside = at >= 0
        total[inside] += np.asarray(n)[at[inside]]
        at = np.where(inside, np.asarray(out)[np.maximum(at, 0)], -1)
    return at, total


FUNCTION = "node long, exits array<long>, counts array<long>"


def _spanned(lines: DataFrame, span: int, size: int, *columns: str) -> DataFrame:
    """Every row in its span, the first ``size`` rows of a span also behind the span before."""
    own = F.floor(F.col("position") / span)
    extra = F.when((F.col("position") % span < size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return lines.select("position", "tok", *columns, F.explode(extra).alias("node"))


def pack(lines: DataFrame, size: int, span: int = SPAN) -> DataFrame:
    """chunk_index, first, last, lines of every chunk of ``lines`` (position from 0 without gaps, line, tok >= 1)."""
    if span < size:
        raise ValueError("a span must hold at least as many rows as a chunk has tokens")
    ready(lines.sparkSession)
    functions = pa.schema([("node", pa.int64()), ("exits", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def evaluate(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        at = table.column("position").to_numpy()
        tokens = table.column("tok").to_numpy()[np.argsort(at)]
        out, count = span_function(tokens, int((at // span == node).sum()), size)
        return pa.table([[node], [out], [count]], schema=functions)

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("node")
        at, total = composed(rows.column("exits").to_pylist(), rows.column("counts").to_pylist())
        return pa.table([[rows.column("node")[0].as_py() // FAN], [at], [total]], schema=functions)

    def descend(table: pa.Table) -> pa.Table:
        rows = table.sort_by("node")
        entry, index = rows.column("entry")[0].as_py(), rows.column("index")[0].as_py()
        out: list[tuple[int, int, int]] = []
        for node, exits, counts in zip(*(rows.column(c).to_pylist() for c in ("node", "exits", "counts")), strict=True):
            if entry < 0:
                break
            out.append((node, entry, index))
            entry, index = exits[entry], index + counts[entry]
        return pa.table([list(c) for c in zip(*out, strict=True)] or [[], [], []], schema=entries)

    entries = pa.schema([("node", pa.int64()), ("entry", pa.int64()), ("index", pa.int64())])
    levels = [stored(_spanned(lines, span, size).groupBy("node").applyInArrow(evaluate, FUNCTION), "spans")]
    while levels[-1].where("node > 0").limit(1).count():
        levels.append(stored(levels[-1].withColumn("up", F.floor(F.col("node") / FAN)).groupBy("up").applyInArrow(lambda t: compose(t), FUNCTION), "spans"))
    entered = levels[-1].where("node = 0").select("node", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("index"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.floor(F.col("node") / FAN)).join(entered.withColumnRenamed("node", "up"), "up")
        entered = stored(below.groupBy("up").applyInArrow(lambda t: descend(t), "node long, entry long, index long"), "entries")
    chunk = pa.schema([("chunk_index", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("lines", pa.list_(pa.string()))])

    def cut(key: tuple, rows: pa.Table, begin: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and begin.num_rows:
            rows = rows.sort_by("position")
            at, texts = rows.column("position").to_numpy(), rows.column("line")
            to, own = jumps(rows.column("tok").to_numpy(), size), int((at // span == key[0].as_py()).sum())
            i, index = begin.column("entry")[0].as_py(), begin.column("index")[0].as_py()
            while i < own:
                t = int(to[i])
                out.append((index, int(at[i]), int(at[t - 1]), texts.slice(i, t - i).to_pylist()))
                i, index = t, index + 1
        return pa.table([list(c) for c in zip(*out, strict=True)] or [[], [], [], []], schema=chunk)

    return _spanned(lines, span, size, "line").groupBy("node").cogroup(entered.groupBy("node")).applyInArrow(cut, "chunk_index long, first long, last long, lines array<string>")
