"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one failure bit per rule; policies
are rows of (version, mask), so a new policy or an ablation reads the ledger and never the text again. Measuring is one
narrow Arrow stage (bounded slices, no shuffle); applying a policy is bitwise DataFrame arithmetic; an ablation is one
aggregation with map-side combine.

Null text: no words (all counts 0). Repeated rows each give a row. Long texts are measured whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_documents

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long"

#: name -> failure test on the measurements. The position of a rule is its bit; only ever append.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "shouting": "n_words >= 20 AND 2 * n_upper > word_chars",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "long_words": "n_words >= 20 AND word_chars > 20 * n_words",
}

#: Versioned policies: a document is dropped when it fails any rule of the mask.
POLICIES: dict[str, list[str]] = {
    "v1": ["few_words", "repeated_words"],
    "v2": ["few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "long_words"],
}


def mask_of(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def repeated(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice in the text, all of its places counted."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    if n < 1 << 21:
        window = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # two steps keep the numbers exact
        _, pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        window = pair * n + ids[2:]
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def measure(ids: list, texts: list[str]) -> dict:
    out: dict[str, list] = {k.split()[0]: [] for k in MEASURES.split(", ")}
    out["doc_id"] = ids
    for text in texts:
        raw = text.encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(text.count(c) for c in SPACES))
        out["n_symbols"].append(sum(text.count(c) for c in SYMBOLS))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated(words))
        codes = np.frombuffer(raw, np.uint8)
        out["n_upper"].append(int(((codes >= 65) & (codes <= 90)).sum()))
        out["n_lines"].append(len(lines))
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed`` (one bit a rule) for every document; write it once and apply policies to it."""
    bits: Column = F.lit(0).cast("long")
    for k, test in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << k)).otherwise(0).cast("long"))
    return map_documents(docs, measure, MEASURES, text).withColumn("failed", bits)


def apply_policy(kept: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept`` and ``policy`` under this version."""
    mask = mask_of(POLICIES[version])
    return kept.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0).withColumn("policy", F.lit(version))


def ablations(ledger_rows: DataFrame, version: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it (kept without the rule), and all documents.

    The distinct bit patterns are counted first (at most 2^rules rows), so one aggregation over the ledger serves all rules.
    """
    mask = mask_of(POLICIES[version])
    patterns = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in POLICIES[version]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )
