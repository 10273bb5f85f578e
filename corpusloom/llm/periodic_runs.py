"""Periodic runs of words, found by an online sparse diagonal DP in each document.

A diagonal is a lag q; its match length at word i counts the consecutive words up to i that equal the word q places
earlier. For each word its earlier occurrences increment the lengths of their lags, a lag that is not incremented ends,
and an ended diagonal that is long enough is a run, emitted at once.

What makes it sparse. A frequent word has thousands of earlier occurrences, nearly all of them useless. A run of period q
holds at least 4 q words, so inside it the G words from a place on (G the power of two with G/2 < q <= G) stand again
exactly q places earlier and nowhere nearer: a nearer place would give the run a smaller period. So for each G one earlier
occurrence of a word counts, the nearest one with the same G - 1 words after it, and only if its lag is in (G/2, G]. A
diagonal of lag q that is incremented c times in a row is c + G - 1 matching words, a stretch of q + c + G - 1 words whose
smallest period is q. The contexts of G words are numbered by doubling, and places whose context does not repeat drop out,
so clean prose costs a few steps a word and any text O(n log n).

Spark deals the documents; the stage is narrow (no shuffle) and a task holds a slice of about 2 MB of texts, or one longer
text. Null and empty texts have no words and no runs. A null doc_id's text is taken as it is (it has no decimal form to
draw a repetition from). Repeated rows each give a row, an empty table none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_documents, slices
from corpusloom.shipping import ready

#: A run has at least so many words, and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` in UTF-8: splitting bytes is by just these six characters."""
    return text.encode().split()


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words a document stands for: for every tenth hash of a doc_id the tail repeats a stretch of it."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def earlier_occurrences(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(G, places, lags): where the G words from a place on stand nearest earlier, at a lag in (G/2, G]; places ascend.

    ``ids`` number the words, differently in each document; ``ends`` and ``sizes`` give a word's document's end and length.
    """
    at, gram, span = np.arange(len(ids)), ids.astype(np.int64), 1
    while len(at):
        order = np.argsort(gram, kind="stable")
        at, gram = at[order], gram[order]
        same, lag = gram[1:] == gram[:-1], np.diff(at)
        hit = np.flatnonzero(same & (lag > span // 2) & (lag <= span))
        by_place = hit[np.argsort(at[hit + 1])]
        yield span, at[by_place + 1], lag[by_place]
        repeated = np.zeros(len(at), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        repeated &= sizes[at] >= MIN_PERIODS * (span + 1)
        number = np.full(len(ids) + span, -1, np.int64)
        number[at[repeated]] = np.concatenate([[0], np.cumsum(~same)])[repeated]
        at = np.sort(at[repeated])
        at = at[at + 2 * span <= ends[at]]
        at = at[number[at + span] >= 0]
        gram = number[at] * len(ids) + number[at + span]
        span *= 2


def runs_of(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; arguments as of :func:`earlier_occurrences`."""
    found = list(earlier_occurrences(ids, ends, sizes))
    if not found:
        return []
    spans = np.repeat([s for s, _, _ in found], [len(p) for _, p, _ in found])
    places, lags = np.concatenate([p for _, p, _ in found]), np.concatenate([q for _, _, q in found])
    order = np.argsort(places, kind="stable")
    active: dict[int, list[int]] = {}  # lag: last place, match length in places, words of context
    out = []

    def end(lag: int) -> None:
        last, count, span = active.pop(lag)
        length = lag + count + span - 1
        if length >= max(MIN_WORDS, MIN_PERIODS * lag):
            out.append((last - count + 1 - lag, length, lag))

    before = -1
    for place, lag, span in zip(places[order].tolist(), lags[order].tolist(), spans[order].tolist(), strict=True):
        if place != before:
            for q in [q for q, d in active.items() if d[0] < place - 1]:
                end(q)
            before = place
        if lag in active:
            active[lag][0] = place
            active[lag][1] += 1
        else:
            active[lag] = [place, 1, span]
    for q in list(active):
        end(q)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words


def numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words (different in each document), and of every word its document's end and length."""
    ids: list[int] = []
    first = 0
    for words in docs:
        of: dict[bytes, int] = {}
        ids.extend([of.setdefault(w, first + len(of)) for w in words])
        first += len(of)
    sizes = np.array([len(w) for w in docs], np.int64)
    return np.array(ids, np.int64), np.repeat(np.cumsum(sizes), sizes), np.repeat(sizes, sizes)


def runs_by_document(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, places counted from its first word; the documents of a slice are walked together."""
    starts = np.cumsum([0, *(len(w) for w in docs)]).tolist()
    each: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    k = 0
    for start, length, period in runs_of(*numbered(docs)):
        while start >= starts[k + 1]:
            k += 1
        each[k].append((start - starts[k], length, period))
    return each


def describe(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = collapse(words, runs) if runs else words
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    exponent = 1000 * longest[1] // longest[2] if runs else None
    return (doc_id, len(words), len(runs), *longest, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept))


def _rows(repeat: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(doc_ids: list, texts: list) -> dict:
        docs = [repeated_tail(words_of(t), i) if repeat else words_of(t) for i, t in zip(doc_ids, texts, strict=True)]
        each = runs_by_document(docs)
        out = [describe(i, w, r) for i, w, r in zip(doc_ids, docs, each, strict=True)]
        return dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    return rows


def find_runs(docs: DataFrame, repeat: bool = False) -> DataFrame:
    """Every document with its runs: number, the longest, digests of the list of runs and of the collapsed text.

    ``repeat`` first makes the tails of every tenth document periodic (:func:`repeated_tail`), as test material.
    """
    return map_documents(docs, _rows(repeat), SCHEMA)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each run of the text cut to one period and the words of such a text joined by one blank.

    A text without a run and a null one stay as they came, and so do all other columns.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                words = [words_of(t or "") for t in texts]
                runs = runs_by_document(words)
                cut = [b" ".join(collapse(w, r)).decode() if r else t for t, w, r in zip(texts, words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, c.type) if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)

    ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
