"""Chunkers. One document's blocks are folded on the JVM; no Python runs and no document leaves its row.

Blocks reach a fold as an ordered array ``bs``: :func:`line_documents` makes it inside the document's row, so nothing is
shuffled; :func:`by_document` gathers it from a table of blocks. The fold keeps index ranges, not texts: a state of two
numbers and the cuts made so far. Chunks are built as an array in the row and only then become rows of their own, so a
document's blocks are never copied for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import packing

#: What the folds read of a block.
BLOCK = ["block_index", "type", "level", "content", "page_number"]
TEXT = "array_join(transform(slice(bs, {0} + 1, {1} - {0}), b -> b.content), '\\n\\n')"


def by_document(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ``bs``: the document's blocks in order, each with its token count. A document is bounded; a table is not."""
    counted = blocks.where("content <> ''").select(key, F.struct(*[F.col(c) for c in BLOCK], T.token_count(F.col("content")).alias("tok")).alias("b"))
    return counted.groupBy(key).agg(F.array_sort(F.collect_list("b")).alias("bs"))


def line_documents(docs: DataFrame, key: str = "doc_id", per_page: int = 40, text: str = "text", mark=None, extra: list[str] | None = None) -> DataFrame:
    """key and ``bs`` with a block a line, made in the document's row. ``mark`` (index, content) -> (type, level, content)
    may tell headings from paragraphs; ``extra`` columns are kept. Documents without a line with a character are left out."""

    def block(raw: Column, i: Column) -> Column:
        content = T.strip(raw)
        kind, level, content = mark(i, content) if mark else (F.lit("paragraph"), F.lit(None).cast("int"), content)
        return F.struct(i.alias("block_index"), kind.alias("type"), level.alias("level"), content.alias("content"), (F.floor(i / per_page) + 1).cast("int").alias("page_number"), T.token_count(content).alias("tok"))

    bs = F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda l: l["x"].rlike(r"\S")), lambda l: block(l["x"], l["i"]))
    return docs.where(F.col(text).rlike(r"\S")).select(key, *(extra or []), bs.alias("bs"))


def _cuts(blocks: str, size: int, overlap: int, at_headings: bool) -> str:
    """SQL: ranges (s, e) of the array ``blocks`` that are chunks, greedily filled to ``size`` tokens.

    State: start of the open chunk, its tokens, cuts. A block that no longer fits closes the chunk; the whole trailing
    blocks of at most ``overlap`` tokens are carried over. With ``at_headings`` a heading closes it without carrying.
    """
    heading = f"({blocks}[i].type = 'heading')" if at_headings else "false"
    carry = f"filter(sequence(a.s, i), j -> aggregate(slice({blocks}, j + 1, i - j), 0, (t, b) -> t + b.tok) <= {overlap})[0]" if overlap else "i"
    tokens = f"aggregate(slice({blocks}, n + 1, i - n), 0, (t, b) -> t + b.tok)"
    closed = f"concat(a.cuts, array(named_struct('s', a.s, 'e', i)))"
    step = (
        f"CASE WHEN i > a.s AND {heading} THEN named_struct('s', i, 't', {blocks}[i].tok, 'cuts', {closed}) "
        f"WHEN i > a.s AND a.t + {blocks}[i].tok > {size} THEN transform(array({carry}), n -> named_struct('s', n, 't', {tokens} + {blocks}[i].tok, 'cuts', {closed}))[0] "
        f"ELSE named_struct('s', a.s, 't', a.t + {blocks}[i].tok, 'cuts', a.cuts) END"
    )
    zero = "named_struct('s', 0, 't', 0, 'cuts', cast(array() AS array<struct<s:int,e:int>>))"
    folded = f"aggregate(sequence(0, size({blocks}) - 1), {zero}, (a, i) -> {step}, a -> concat(a.cuts, array(named_struct('s', a.s, 'e', size({blocks})))))"
    return f"CASE WHEN size({blocks}) > 0 THEN {folded} ELSE cast(array() AS array<struct<s:int,e:int>>) END"


def heading_path(blocks: str, upto: str) -> str:
    """SQL: the heading path after the first ``upto`` blocks: a heading of level L cuts the path to L - 1 and is appended."""
    return (
        f"aggregate(filter(slice({blocks}, 1, {upto}), b -> b.type = 'heading'), cast(array() AS array<string>), "
        "(p, h) -> concat(CASE WHEN coalesce(h.level, 1) <= size(p) THEN slice(p, 1, coalesce(h.level, 1) - 1) ELSE p END, array(h.content)))"
    )


def _paths(blocks: str) -> str:
    """SQL: (at, path) of every heading: the path after it, found in one fold."""
    step = (
        "concat(CASE WHEN coalesce(h.b.level, 1) <= size(a.path) THEN slice(a.path, 1, coalesce(h.b.level, 1) - 1) ELSE a.path END, array(h.b.content))"
    )
    return (
        f"aggregate(filter(transform({blocks}, (b, i) -> named_struct('b', b, 'i', i)), x -> x.b.type = 'heading'), named_struct('path', cast(array() AS array<string>), 'all', cast(array() AS array<struct<at: int, path: array<string>>>)), "
        f"(a, h) -> transform(array({step}), p -> named_struct('path', p, 'all', concat(a.all, array(named_struct('at', h.i, 'path', p)))))[0], a -> a.all)"
    )


def block_paths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block_index, path) of every block of ``docs`` (key, bs): the headings that it stands under, itself included. One
    fold over the headings; a heading's path is given to all blocks up to the next one."""
    first = "named_struct('at', 0, 'path', cast(array() AS array<string>))"
    spans = f"transform(array(concat(array({first}), {_paths('bs')})), ps -> transform(ps, (p, n) -> named_struct('s', p.at, 'e', coalesce(get(ps, n + 1).at, size(bs)), 'path', p.path)))[0]"
    each = f"flatten(transform(filter({spans}, p -> p.e > p.s), p -> transform(slice(bs, p.s + 1, p.e - p.s), b -> named_struct('block_index', b.block_index, 'path', p.path))))"
    return docs.select(key, F.explode(F.expr(each)).alias("b")).select(key, "b.block_index", "b.path")


def _chunks(docs: DataFrame, key: str, prefix: str, size: int, overlap: int, at_headings: bool, strict: bool) -> DataFrame:
    """One row a chunk: its range, text, tokens, id, page and heading path.

    By default page and path are those after the block that closed the chunk; ``strict`` takes the chunk's own last
    block. A heading that closes a chunk is not yet in its path.
    """
    stop = "c.e" if strict else f"least(size(bs), c.e + {'if(coalesce(get(bs, c.e).type, \"\") = \"heading\", 0, 1)' if at_headings else '1'})"
    page = "bs[c.e - 1].page_number" if strict else "bs[least(size(bs) - 1, c.e)].page_number"
    path = f"coalesce(try_element_at(filter(ps, p -> p.at < {stop}), -1).path, cast(array() AS array<string>))"
    chunk = f"named_struct('text', {TEXT.format('c.s', 'c.e')}, 'page_number', {page}, 'heading_path', {path}, 'first_block', c.s, 'end_block', c.e)"
    # Exploded as an expression: the filter that is inferred for a column would compute the blocks again for each use.
    each = docs.select(key, F.posexplode(F.expr(f"transform(array({_paths('bs')}), ps -> transform({_cuts('bs', size, overlap, at_headings)}, c -> {chunk}))[0]")).alias("chunk_index", "c"))
    return each.select(
        key,
        "chunk_index",
        T.chunk_id(F.col(key).cast("string"), prefix, F.col("chunk_index"), F.col("c.text")).alias("chunk_id"),
        "c.text",
        T.token_count(F.col("c.text")).alias("token_count"),
        "c.page_number",
        "c.heading_path",
        "c.first_block",
        "c.end_block",
    )


def chunk_boundary(docs: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """Whole blocks packed to ``size`` tokens with carried overlap. ``docs`` comes from :func:`by_document`."""
    return _chunks(docs, key, "bnd", size, overlap, False, strict)


def chunk_section(docs: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id") -> DataFrame:
    """As :func:`chunk_boundary`, closed at every heading too, and tagged with the canonical section of its last heading."""
    chunks = _chunks(docs, key, "sec", size, overlap, True, False)
    last = F.try_element_at("heading_path", F.lit(-1))
    return chunks.withColumn("section_type", F.when(last.isNull(), "preamble").otherwise(T.section_of(last)))


def chunk_hierarchical(docs: DataFrame, child: int = 192, parent: int = 768, key: str = "doc_id") -> DataFrame:
    """Parents closed at headings or ``parent`` tokens, their children of ``child`` tokens inside them without overlap.

    chunk_type is parent_chunk or child_chunk; a child has parent_chunk_id, and both counters run over the document.
    """
    name = lambda prefix, n, text: f"concat('chk_', replace(substring(_id, 1, 8), '-', ''), '_{prefix}_', lpad(cast({n} AS string), 5, '0'), '_', substring(sha2({text}, 256), 1, 8))"
    inner = _cuts("slice(bs, p.s + 1, p.e - p.s)", child, 0, False)
    kids = f"transform({inner}, c -> {TEXT.format('(p.s + c.s)', '(p.s + c.e)')})"
    page = "bs[least(size(bs) - 1, p.e)].page_number"
    parents = f"transform({_cuts('bs', parent, 0, True)}, (p, n) -> named_struct('n', n, 'text', {TEXT.format('p.s', 'p.e')}, 'page', {page}, 'kids', {kids}))"
    docs = docs.select(key, F.col(key).cast("string").alias("_id"), "bs").select(key, "_id", F.expr(parents).alias("ps"))
    row = "named_struct('chunk_type', '{0}', 'chunk_index', {1}, 'chunk_id', {2}, 'parent_chunk_id', {3}, 'text', {4}, 'page_number', p.page)"
    before = "aggregate(slice(ps, 1, p.n), 0, (a, x) -> a + size(x.kids))"
    kid = row.format("child_chunk", "b + j", name("chi", "b + j", "k"), "pid", "k")
    whole = row.format("parent_chunk", "p.n", "pid", "cast(NULL AS string)", "p.text")
    both = f"flatten(transform(ps, p -> transform(array({name('par', 'p.n', 'p.text')}), pid -> transform(array({before}), b -> concat(array({whole}), transform(p.kids, (k, j) -> {kid})))[0])[0]))"
    return docs.select(key, F.explode(F.expr(both)).alias("c")).select(key, "c.*").withColumn("token_count", T.token_count(F.col("text")))


def schema_chunk(rows: DataFrame, name: str, columns: list[str], kinds: DataFrame, sheet: str = "main") -> DataFrame:
    """One row (chunk_type, text): the sheet's name, size, columns and their types. ``kinds`` has (column, inferred_type), as
    :func:`corpusloom.operators.profile.column_profile` gives it, so the text costs one aggregation."""
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)])
    listed = kinds.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("column", "inferred_type"))).alias("of"))
    typed = listed.select(F.concat_ws(", ", F.transform(order, lambda x: F.concat(x["c"], F.lit(" ("), F.coalesce(F.col("of")[x["c"]], F.lit("string")), F.lit(")")))).alias("typed"))
    text = F.concat_ws("\n", F.lit(f"Dataset: {name}"), F.lit(f"Sheet: {sheet}"), F.concat(F.lit("Total Rows: "), F.col("n").cast("string")), F.lit(f"Total Columns: {len(columns)}"), F.concat(F.lit("Columns & Types: "), "typed"))
    return rows.agg(F.count("*").alias("n")).crossJoin(typed).select(F.lit("tabular_schema").alias("chunk_type"), text.alias("text"))


def chunk_tabular(rows: DataFrame, name: str, columns: list[str], position: str, size: int = 512, sheet: str = "main", span: int | None = None) -> DataFrame:
    """(chunk_index, first_row, last_row, text): rows as 'Row n: column: value; ...' packed greedily to ``size`` tokens under
    a header with their range; :func:`schema_chunk` is the sheet's other chunk.

    ``position`` counts the rows from 0 without gaps (:func:`corpusloom.operators.sampling.numbered` gives it). The chunks
    are those of one fold over the whole table, and no task sees more than ``span`` rows and the ``size`` after them
    (:mod:`corpusloom.operators.packing`).
    """
    filled = F.array_compact(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]))
    number = (F.col(position) + 1).cast("long")
    line = F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.concat_ws("; ", filled))
    lines = rows.select((number - 1).alias("position"), line.alias("line"), T.token_count(line).alias("tok"))
    header = F.concat(F.lit(f"Dataset: {name} | Sheet: {sheet} (Rows "), F.col("first_row").cast("string"), F.lit("–"), F.col("last_row").cast("string"), F.lit(")\n"))
    packed = packing.pack(lines, size, span or max(packing.SPAN, size))
    return packed.select("chunk_index", (F.col("first") + 1).alias("first_row"), (F.col("last") + 1).alias("last_row"), "lines").select("chunk_index", "first_row", "last_row", F.concat(header, F.array_join("lines", "\n")).alias("text"))


def token_safe_split(chunks: DataFrame, limit: int = 512, overlap: int = 50, key: str = "chunk_id") -> DataFrame:
    """(key, sub_index, text): chunks over ``limit`` tokens cut into paragraphs, sentences or word batches, then packed.

    Units are paragraphs, or sentences of a paragraph over half the limit; a unit over the limit is cut into batches of
    words at an estimated 0.35 tokens a character. Chunks within the limit stay as they are.
    """
    words = "transform(filter(split(u, '\\\\s+'), w -> w <> ''), w -> named_struct('content', w, 'type', 'w', 'tok', greatest(1, cast(floor(length(w) * 0.35D) AS int))))"
    batch = f"transform(array({words}), ws -> transform({_cuts('ws', limit, 0, False)}, c -> array_join(transform(slice(ws, c.s + 1, c.e - c.s), w -> w.content), ' ')))[0]"
    tokens = lambda x: f"CASE WHEN regexp_count({x}, '\\\\S+') > 0 THEN greatest(1, cast(floor(regexp_count({x}, '\\\\S+') * 1.33D) AS int)) ELSE 0 END"
    para = f"CASE WHEN {tokens('p')} > {limit // 2} THEN split(p, '(?<=[.!?])\\\\s+') ELSE array(p) END"
    units = f"filter(transform(flatten(transform(split(trim(text), '\\n\\n'), p -> {para})), u -> trim(u)), u -> u <> '')"
    safe = f"flatten(transform({units}, u -> CASE WHEN {tokens('u')} > {limit} THEN {batch} ELSE array(u) END))"
    counted = chunks.select(key, "text", F.expr(f"CASE WHEN {tokens('text')} <= {limit} THEN array(text) ELSE {safe} END").alias("us"))
    packed = counted.select(key, F.expr(f"transform(us, u -> named_struct('content', u, 'type', 'u', 'tok', {tokens('u')}))").alias("bs"))
    texts = F.expr(f"transform({_cuts('bs', limit, overlap, False)}, c -> {TEXT.format('c.s', 'c.e')})")
    return packed.select(key, F.posexplode(texts).alias("sub_index", "text"))
