"""URL filter: allow and block entries in a trie over reversed host labels and path segments, longest match first.

The rule list is configuration. It is collected only after its count and bytes are checked (``max_rules``, ``max_bytes``; a
trie takes some 60 times the bytes of its rules), built into one trie and broadcast; pages are judged in a narrow stage
without a shuffle. A longer list is not collected: the trie's levels
become keys (host suffix, whole path segments), and the different addresses meet the rules in an equi-join. A null URL, or
one without ``://``, has an empty host and path and so fits no rule. Repeated rows each give a row, an empty table none;
of equal entries with different verdicts the block counts. Columns of ``pages`` besides the key and the URL are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.shipping import ready

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MAX_RULES, MAX_BYTES = 50_000, 1 << 20

#: The method's own verdict on what no entry covers. Host labels (whole, or between hyphens) that name spam
#: shops, and marks of made-up hosts: an address of digits, many hyphens, many digits, or a label that is too long.
SPAM_WORDS = "spam casino pills xxx porn viagra cialis poker jackpot bingo betting lottery payday escort replica hookup torrent warez keygen cheap-meds".split()
SPAM_LABEL = r"(^|[.-])(" + "|".join(SPAM_WORDS) + r")([.-]|$)"
ODD_HOST = r"^[0-9.]+$|^\[|-[^.]*-[^.]*-[^.]*-|[0-9][^.]*[0-9][^.]*[0-9][^.]*[0-9][^.]*[0-9][^.]*[0-9]|[^.]{40,}"

_tries: dict[str, Node] = {}


class Node:
    """A host label or a path segment; ``rules`` holds the entries that end here, as (last partial segment, name, verdict)."""

    __slots__ = ("hosts", "paths", "rules")

    def __init__(self) -> None:
        self.hosts: dict[str, Node] = {}
        self.paths: dict[str, Node] = {}
        self.rules: list[tuple[str, str, str]] = []


def segments(path: str) -> list[str]:
    """A path cut after each slash: '/en/a' gives '/', 'en/', 'a'."""
    return re.findall(r"[^/]*/|[^/]+", path)


def build_trie(rules: list[tuple[str, str, str]]) -> Node:
    root, full = Node(), []
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.hosts.setdefault(label, Node())
        cut = segments(path)
        partial = "" if not cut or cut[-1].endswith("/") else cut.pop()
        for segment in cut:
            node = node.paths.setdefault(segment, Node())
        node.rules.append((partial, host + path, verdict))
        full.append(node)
    for node in full:
        if len(node.rules) > 1:
            node.rules.sort(key=lambda r: (-len(r[0]), r[2] != "block"))  # of two equal entries the block wins
    return root


def longest(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest entry: more host labels first, then more path, then block before allow."""
    best, node, cut = None, root, segments(path)
    for label in reversed(host.split(".")) if host else ():
        node = node.hosts.get(label)
        if node is None:
            break
        here, at, depth = node, 0, 0
        while here is not None:
            rest = cut[depth] if depth < len(cut) else ""
            for partial, name, verdict in here.rules:
                if rest.startswith(partial):
                    best = (name, verdict)
                    break
            here, depth = (here.paths.get(cut[depth]) if depth < len(cut) else None), depth + 1
    return best


def host_of(url: Column) -> Column:
    """From the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://'."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def own_verdict(host: Column) -> Column:
    return F.when(host.rlike(SPAM_LABEL) | host.rlike(ODD_HOST), "block").otherwise("allow")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", max_rules: int = MAX_RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """key, host, path, rule and verdict for every row of ``pages``. ``rules`` has host, path, verdict (allow or block)."""
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    many = n > max_rules or size > max_bytes
    cut = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = _by_join(cut, rules) if many else _by_trie(cut, [tuple(r) for r in rules.select("host", "path", "verdict").collect()])
    return judged.select(key, "host", "path", "rule", F.coalesce("ruled", own_verdict(F.col("host"))).alias("verdict"))


def _by_trie(cut: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The addresses with ``rule`` and ``ruled``; each Python worker builds the trie once."""
    shared, name = ready(cut.sparkSession).sparkContext.broadcast(rules), uuid.uuid4().hex

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if name not in _tries:
            _tries.clear()
            _tries[name] = build_trie(shared.value)
        for host, path in batches:
            found = [longest(_tries[name], h, p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame({"rule": [f and f[0] for f in found], "verdict": [f and f[1] for f in found]})

    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return cut.withColumn("j", F.pandas_udf(judge, kind)("host", "path")).select("*", F.col("j.rule").alias("rule"), F.col("j.verdict").alias("ruled"))


def _by_join(cut: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: a rule is keyed by its host and whole path segments, an address by every suffix of
    its host and every run of its first segments. Different addresses are joined once; the best rule is an aggregate."""
    whole = F.regexp_extract("path", r"^(.*/)?", 0)
    keyed = rules.select(F.lower("host").alias("_h"), whole.alias("_p"), F.concat("host", "path").alias("rule"), F.col("path").alias("_path"), F.col("verdict").alias("ruled"))
    address = cut.select("host", "path").distinct()
    suffixes = F.expr("transform(filter(sequence(1, length(host)), i -> i = 1 OR substring(host, i - 1, 1) = '.'), i -> substring(host, i))")
    runs = F.expr("transform(filter(sequence(0, length(path)), i -> i = 0 OR substring(path, i, 1) = '/'), i -> substring(path, 1, i))")
    met = address.where("host <> ''").select("host", "path", F.explode(suffixes).alias("_h")).select("host", "path", "_h", F.explode(runs).alias("_p")).join(keyed, ["_h", "_p"]).where("startswith(path, _path)")
    rank = F.struct(F.size(F.split("_h", r"\.")), F.length("_path"), F.when(F.col("ruled") == "block", 1).otherwise(0))
    best = met.groupBy(F.col("host").alias("_host"), F.col("path").alias("_address")).agg(F.max_by(F.struct("rule", "ruled"), rank).alias("_best"))
    return cut.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_address")), "left").select(*cut.columns, "_best.rule", "_best.ruled")
