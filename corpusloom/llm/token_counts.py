"""Token counts of whole texts from counts of distinct pre-tokens; ids of a text are never made.

A sentencepiece BPE model merges neighbouring symbols into pieces of its vocabulary. Where no piece holds the two
characters on both sides of a border, no merge can cross it, so the number of tokens of a text is the sum over the parts
between such borders. No piece of these models holds a blank after another character (checked when the model is loaded),
so a text is cut before each run of blanks, around white space that no piece holds, and parts of over ``LONG``
characters also between any two characters that stand together in no piece. These parts are the pre-tokens.

Plan. One pass counts the pre-tokens of the corpus (map-side combined); each distinct one is counted once with the
library, which gives a table (pre-token, frequency, tokens). A second pass makes each document's pre-token frequencies.
They meet the table in two ways that are one join split by frequency: at most ``HEAD`` of the most frequent pre-tokens, of
at most ``LONG`` characters (some 45 MB in a Python worker, 120 MB at the most, on any corpus), go to every task, so
frequent pre-tokens are never shuffled; the rest - (row, pre-token, frequency) of rare pre-tokens - meets the rest of the
table in an equi-join whose keys are rare by construction, however many copies a text has.

Null and empty texts have no bytes and no tokens. Repeated rows each give a row, an empty table none; columns besides
doc_id and the text are not read. A special token's string in a text is ordinary text, as for the library.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import slices, stored
from corpusloom.shipping import ready

#: Frequent pre-tokens that every task holds; characters beyond which a pre-token is cut further and never among them.
HEAD, LONG = 400_000, 48
#: Steps of the histogram of frequencies between a number and its double.
STEPS = 16
#: Distinct pre-tokens that a counting task holds before it gives its counts on.
HELD = 300_000
#: Fixed value: the mark of a blank in pieces.
BLANK = "▁"

TABLE = "word string, freq long, tokens long"


class Pieces:
    """A sentencepiece BPE model as far as counting needs it."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    @cached_property
    def vocabulary(self) -> list[str]:
        m = self.model
        return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]

    @cached_property
    def together(self) -> frozenset[str]:
        """Pairs of characters that stand together in a piece."""
        return frozenset(p[k : k + 2] for p in self.vocabulary for k in range(len(p) - 1))

    @cached_property
    def alone(self) -> list[str]:
        """White space that no piece holds."""
        known = set("".join(self.vocabulary))
        return [c for c in "\t\n\x0b\x0c\r" if c not in known]

    @cached_property
    def pattern(self) -> re.Pattern[str]:
        alone = re.escape("".join(self.alone))
        return re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def check(self) -> None:
        """Raise for a model whose merges may cross a blank or whose texts are changed before the merges."""
        m = self.model
        if any(a != BLANK and b == BLANK for a, b in self.together):
            raise ValueError(f"{self.path}: a piece holds a blank after another character, so words cannot be counted alone")
        sample = "a  béﬁ ①"
        if m.normalize(sample) != BLANK + sample.replace(" ", BLANK) or not any(m.is_byte(i) for i in range(m.get_piece_size())):
            raise ValueError(f"{self.path}: only models without normalization and with byte pieces are supported")

    def split(self, text: str) -> list[str]:
        """The parts of a text at blanks and lone white space, in order; some may be empty, long ones are not cut yet."""
        if not text:
            return []
        if "  " in text or BLANK in text:
            return self.pattern.findall(BLANK + text.replace(" ", BLANK))
        marked = f"{BLANK}{text.replace(' ', ' ' + BLANK)}" if text[0] != " " else f"{BLANK}{BLANK}{text[1:].replace(' ', ' ' + BLANK)}"
        for c in self.alone:
            if c in marked:
                marked = marked.replace(c, f" {c} ")
        return marked.split(" ")

    def frequencies(self, parts: Counter[str]) -> Counter[str]:
        """Pre-tokens with their frequencies: parts with the long ones cut."""
        for p in [p for p in parts if len(p) > LONG]:
            n = parts.pop(p)
            for x in self.cut(p):
                parts[x] += n
        return parts

    def cut(self, part: str) -> list[str]:
        at = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.together), len(part)]
        return [part[a:b] for a, b in zip(at, at[1:], strict=False)]

    def tokens(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token. Behind a tab, which no merge crosses, the library adds no blank of its own."""
        return [len(x) - self._tab for x in self.model.encode(["\t" + w for w in words], num_threads=1)]

    @cached_property
    def _tab(self) -> int:
        if any("\t" in p for p in self.vocabulary):
            raise ValueError(f"{self.path}: a piece holds a tab")
        return len(self.model.encode("\t"))


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a path, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word, freq, tokens: every distinct pre-token of the texts, counted once."""
    pair = pa.schema([("word", pa.string()), ("freq", pa.int64())])
    table = pa.schema([("word", pa.string()), ("freq", pa.int64()), ("tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held = pieces(path), Counter()

        def out() -> pa.RecordBatch:
            words = p.frequencies(held)
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], schema=pair)

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    held.update(p.split(t))
                    if len(held) > HELD:
                        yield out()
                        held = Counter()
        yield out()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces(path).tokens(part.column(0).to_pylist()), pa.int64())], schema=table)

    words = _texts(docs, text).select("text").mapInArrow(count, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))
    return words.mapInArrow(measure, TABLE)


def frequent(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words, no rarer than any other: those above a frequency that a histogram of some hundred steps gives, so
    nothing is sorted and no task gathers words."""
    step = F.floor(F.log2("freq") * STEPS)
    least, n = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        n += r["n"]
        if n > most:
            break
        least = r["step"]
    return words.where(F.lit(False) if least is None else step >= least)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row; ``path`` names a sentencepiece model on every executor."""
    spark = ready(docs.sparkSession)
    pieces(path).check()
    words = stored(word_table(docs, path, text), "words")
    top = frequent(words.where(F.length("word") <= LONG), head)
    known = spark.sparkContext.broadcast({w: n for w, n in top.select("word", "tokens").toLocalIterator()})
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("n_bytes", pa.int64()), ("known", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, tokens = pieces(path), known.value
        for batch in batches:
            for part in slices(batch, 1):
                sizes, sums, words, counts = [], [], [], []
                for t in part.column(1).to_pylist():
                    of = p.frequencies(Counter(p.split(t)))
                    each = list(map(tokens.get, of))
                    rare = [(w, n) for w, n, x in zip(of, of.values(), each, strict=True) if x is None] if None in each else []
                    sums.append(sum(n * x for n, x in zip(of.values(), each, strict=True) if x))
                    words.append([w for w, _ in rare])
                    counts.append([n for _, n in rare])
                    sizes.append(len(t.encode()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip((sizes, sums, words, counts), list(schema)[1:], strict=True))], schema=schema)

    split = _texts(docs, text).mapInArrow(count, f"doc_id {id_type.simpleString()}, n_bytes long, known long, words array<string>, counts array<long>")
    rows = stored(split.withColumn("row", F.monotonically_increasing_id()), "counted")
    rest = rows.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    sums = rest.join(words.select("word", "tokens"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
