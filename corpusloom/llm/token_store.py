"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its frequency rank in the whole corpus, so frequent ids take one byte. A rank takes 1 to 4 data
bytes; its length code (2 bits) goes to a control stream, four codes a byte. A reader looks the control bytes up in a
256-row table of lengths, turns lengths into offsets with one cumulative sum and gathers the data bytes with numpy.

Jobs: (1) tokenize once (one look-up for each distinct word of some MB of texts) into a compressed intermediate table in
the shared folder; (2) count ids (bincount of many documents, then a sum by id: at most one row an id and task leaves a
task; the rank table is bounded by the vocabulary and broadcast);
(3) range-partition by doc_id, sort, and pack runs of documents into blocks; a task writes the blocks of its range with
their running offset; (4) the bases of the ranges are a running sum over one row a file. Blocks are written and read by
Spark as a Parquet table of binary streams, so any store that Spark reaches works, and a lost task is written again.

Null text: as an empty one (the end id alone). Rows that repeat a doc_id stand next to each other, each with its own
start. A text longer than a block is a block of its own. Ids are kept in 16 bits while they are counted if the whole
vocabulary fits, else in 32. An empty table gives no block and no row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import byte_alphabet
from corpusloom.llm.common import remove, shared_path, slices, stored
from corpusloom.shipping import ready

END_ID = 1
#: Ids a block holds before it is closed.
BLOCK_IDS = 65_536
#: Entries a worker keeps from words to ids; a full cache keeps what it has.
WORDS, PIECES = 800_000, 700_000
#: Bytes of texts whose words are told apart at one time (one text at least), and words whose ids are laid out at one time.
TEXT_BYTES, STEP = 8 << 20, 1 << 20
#: Ids that are counted at one time (those of one document at least).
COUNT_IDS = 1 << 20

#: control byte -> lengths of its four values
LENGTHS = np.array([[1 + (c >> (2 * k) & 3) for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = (v[has] >> (8 * k)) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class WordCoder:
    """The tokenizers library behind a bounded cache from words to ids, for tokenizers that drop white space.

    Tokens never cross white space, so a text's ids are those of its words in order. Only ' ' and '\\n' cut words here;
    other white space stays inside a word and is left to the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(not a or a.split() != [a] for a in added):
            raise ValueError("added tokens with white space cross words")
        self.added = "|".join(map(re.escape, added))
        self.packed = [int(i).to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _library(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _run(self, run: str) -> bytes:
        """Ids of one run of lower-case letters or of marks: nothing is left to normalize or to split, so only the model works."""
        if not run.isascii():
            run = "".join([self.alphabet[b] for b in run.encode()])
        return b"".join([self.packed[t.id] for t in self.model.tokenize(run)])

    def _fresh(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words that are not in the cache."""
        # A run of letters with ASCII marks around falls into three runs that the library's model also takes one by one.
        left = pc.ascii_ltrim(words, MARKS)
        core = pc.ascii_rtrim(left, MARKS)
        plain = pc.match_substring_regex(core, LETTERS)
        if self.added:
            plain = pc.and_not(plain, pc.match_substring_regex(words, self.added, ignore_case=True))
        before = pc.subtract(pc.binary_length(words), pc.binary_length(left)).to_pylist()
        after = pc.subtract(pc.binary_length(left), pc.binary_length(core)).to_pylist()
        texts, runs = _strings(words), _strings(pc.utf8_lower(core))
        out, odd = [b""] * len(texts), []
        known, here = self.pieces.get, {}

        def ids(run: str) -> bytes:
            got = known(run) or here.get(run)
            if got is None:
                got = here[run] = self._run(run)
            return got

        for k, (ok, w, run, a, b) in enumerate(zip(plain.to_pylist(), texts, runs, before, after, strict=True)):
            if not ok:
                odd.append(k)
            elif a or b:
                out[k] = (ids(w[:a]) if a else b"") + ids(run) + (ids(w[-b:]) if b else b"")
            else:
                out[k] = ids(run)
        for k, got in zip(odd, self._library([texts[k] for k in odd]) if odd else [], strict=True):
            out[k] = got
        self.pieces.update(islice(here.items(), max(0, PIECES - len(self.pieces))))
        return out

    def encode(self, texts: pa.Array, end_id: int, width: str) -> pa.Array:
        """Of each text its ids and the end id, as integers of ``width``.

        The words of all texts are cut and told apart by Arrow; only distinct ones become Python strings, and numpy lays
        their ids out in the order of the texts, STEP words at a time.
        """
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = _strings(coded.dictionary)
        parts = list(map(self.words.get, words))
        new = [k for k, p in enumerate(parts) if p is None]
        if new:
            fresh = self._fresh(coded.dictionary.take(pa.array(new)))
            for k, p in zip(new, fresh, strict=True):
                parts[k] = p
            self.words.update(islice(zip([words[k] for k in new], fresh, strict=True), max(0, WORDS - len(self.words))))
        parts.append(np.array([end_id], "<u4").tobytes())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(parts), "<u4").astype(width)
        # The end mark is one more word behind each text.
        ends = np.cumsum(cut.value_lengths().to_numpy(), dtype=np.int64)
        which = np.insert(coded.indices.to_numpy(), ends, len(parts) - 1)
        upto = np.cumsum(sizes[which])
        out = np.empty(int(upto[-1]) if len(upto) else 0, width)
        done = 0
        for at in range(0, len(which), STEP):
            some = which[at : at + STEP]
            n, to = sizes[some], int(upto[min(at + STEP, len(which)) - 1])
            out[done:to] = flat[np.repeat(first[some] - (upto[at : at + STEP] - n), n) + np.arange(done, to)]
            done = to
        offsets = np.zeros(len(ends) + 1, np.int64)
        offsets[1:] = upto[ends + np.arange(len(ends))] * out.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


#: ASCII marks that never join letters in one token; the apostrophe can ('s, 'll), so words with it are left whole.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of one code point that stay one composed code point when lower-cased.
LATIN = frozenset(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]) if c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c.lower()) == c.lower())

#: A core of such letters alone.
LETTERS = f"^[{''.join(sorted(LATIN))}]+$"

_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


@cache
def vocabulary_of(path: str, end_id: int = END_ID) -> int:
    """One more than the largest id that the tokenizer or the end mark can give."""
    from tokenizers import Tokenizer

    return 1 + max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def width_of(vocabulary: int) -> str:
    """The type of stored ids: 16 bits if all ids fit, else 32."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian integers of the ``width`` of the vocabulary) with the end id."""
    width = width_of(vocabulary_of(path, end_id))
    names = ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, batch.num_rows, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), coder(path).encode(part.column(1), end_id, width)], names=names)

    ready(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def frequency_ranks(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """ids in order of falling frequency (ties: smaller id first), over all rows. The result is bounded by the vocabulary."""
    width = width_of(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for v in b.column(0):
                held.append(np.frombuffer(v.as_buffer(), width))
                size += len(held[-1])
                if size >= COUNT_IDS:
                    total += np.bincount(np.concatenate(held), minlength=vocabulary)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(vocabulary, np.int64)
    for r in rows:
        n[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocabulary), -n)).astype(np.uint32)


BLOCKS = "part int, seq int, base long, n_ids long, doc_ids binary, no_id binary, lengths binary, control binary, data binary"


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, text: str = "text", block_ids: int = BLOCK_IDS) -> np.ndarray:
    """Write the corpus as blocks in ascending doc_id order under ``path``; returns the rank table (bounded by the vocabulary)."""
    spark = docs.sparkSession
    vocabulary = vocabulary_of(tokenizer, end_id)
    width = width_of(vocabulary)
    tokens = stored(tokenize(docs, tokenizer, end_id, text), "token-ids")
    by_rank = frequency_ranks(tokens, vocabulary)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            values = ranks.value[np.concatenate(held)]
            control, data = pack(values)
            lengths = np.array([len(h) for h in held], "<u4")
            row = {"part": part, "seq": seq, "base": base, "n_ids": len(values), "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "no_id": np.array([i is None for i in ids], np.uint8).tobytes(), "lengths": lengths.tobytes(), "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        size = 0
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = np.frombuffer(v.as_buffer(), width)
                if held and size + len(one) > block_ids:
                    yield block()
                    seq, base, ids, held, size = seq + 1, base + size, [], [], 0
                ids.append(i)
                held.append(one)
                size += len(one)
        if held:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], BLOCKS).schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(path)
    remove(tokens)
    return by_rank


def read_store(spark, path: str, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the blocks under ``path``."""
    blocks = ready(spark).read.schema(BLOCKS).parquet(path)
    ids = spark.sparkContext.broadcast(by_rank)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(k)[r] for k, name in enumerate(b.schema.names)}
                raw = lambda name: row[name].as_buffer()  # noqa: E731, B023
                lengths = np.frombuffer(raw("lengths"), "<u4").astype(np.int64)
                values = ids.value[unpack(raw("control"), raw("data"), row["n_ids"].as_py())].astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                body = memoryview(values.tobytes())
                absent = np.frombuffer(raw("no_id"), np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), row["part"].as_py(), np.int32)),
                        pa.array(np.frombuffer(raw("doc_ids"), "<i8"), mask=absent),
                        pa.array(starts + row["base"].as_py()),
                        pa.array(lengths),
                        pa.array([zlib.crc32(body[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["part", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    documents = blocks.mapInArrow(decode, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # One row a file: the running sum is over the number of range partitions, not over documents.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return documents.join(F.broadcast(bases), "part").select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Write the whole table in the file format in the shared folder and read it back."""
    path = shared_path(docs.sparkSession, "token-store")
    return read_store(docs.sparkSession, path, write_store(docs, tokenizer, path, text=text))
