"""The trie of conversations' common beginnings, from vertical bitmaps.

Every distinct sequence of a conversation's first d turns is a node of depth d. Bitmaps stand the table on its side: in a
shard of ``SHARD`` consecutive conversation ids, (position, turn) maps to the bitset of the conversations that have this
turn there. The children of a node are found depth first: the parent's bitset is intersected with the posting of its lowest
member's next turn, the hits are taken away, and so on, one intersection a child. A child's popcount is its number of
members, its lowest bit the smallest member, and the intersection with the bitset of conversations that end there its list
of ends.

Nothing depends on how many conversations share a beginning. Shards are ranges of ids, so a node that a third of all
conversations share is one row of every shard, and these rows are summed. A node is known by the XOR of hashes of
(position, turn), 128 bits, so shards agree on it without exchanging texts; texts never leave the scan. Long
conversations are cut into segments of ``SEGMENT`` turns: the XOR of the earlier segments says where in the trie a segment
starts, so a task holds at most SHARD x SEGMENT turns however long a conversation is.

Sums over subtrees follow paths. A node's smallest member owns it, and a conversation's nodes are one path that hangs on a
path of a smaller id. The paths, one row a conversation, are summed by pointer doubling (as many rounds as the logarithm of
how deep paths hang on paths) over tables in the shared folder, and then each path from its end. Lists of ends are hashed
while their pieces, which ascend with the shards, stream through a task: never a whole list in memory.

Turns are ordered by turn (null first), then by a digest of role and text, so rows of one turn number have a defined
order. Null role or text is an empty one. Rows without conv_id belong to no conversation and make no node. Repeated rows
are turns of their own. An empty table gives no node. Columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.shipping import ready

#: Conversation ids of a shard (a bitset's bits), and turns of a segment.
SHARD, SEGMENT = 500, 256
#: Turn numbers that are ordered together, so that one long conversation is many groups.
BUCKET = 256
#: Conversations whose id is a multiple lend their first turns to the ids after it; so many turns at most.
FAMILY, MOST_SHARED = 100, 6

NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, chars long, shard long, ends array<long>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, bucket, digest, chars of every turn with a conversation: what is left of the texts from here on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    bucket = F.coalesce(F.floor(F.col("turn") / F.lit(BUCKET)), F.lit(-(2**62)))
    return conversations.where("conv_id is not null").select("conv_id", "turn", bucket.alias("bucket"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def _in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest")]


def positions(turns: DataFrame) -> DataFrame:
    """Each turn's place in its conversation. Groups of BUCKET turn numbers are ordered alone and put behind one another."""
    counts = turns.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(*_in_order())))
    return ranked.join(counts.select("conv_id", "bucket", before.alias("before")), ["conv_id", "bucket"]).select("conv_id", (F.col("before") + F.col("rank") - 1).alias("pos"), "digest", "chars")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with positions, conversations with their lengths)."""
    return positions(turns), turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`as_they_are`, of conversations that begin with turns of their family's first one.

    The first h = crc32(conv_id) mod 6 turns of a conversation are replaced by the first h (all, if fewer; none, if absent)
    of the conversation conv_id - conv_id % 100.
    """
    first = turns.where(F.col("conv_id") % FAMILY == 0).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_in_order()))).where(F.col("rank") < MOST_SHARED)
    head = first.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "chars"))).alias("head"))
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")).join(head, "family", "left")
    shared = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = stored(convs.select("conv_id", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"), F.slice(F.coalesce("head", F.array()), 1, MOST_SHARED).alias("head")), "rebuilt")
    lent = convs.where("shared > 0").select("conv_id", F.explode(F.expr("slice(head, 1, int(shared))")).alias("t")).select("conv_id", (F.col("t.rank") - 1).cast("long").alias("pos"), "t.digest", "t.chars")
    own = positions(turns).join(convs.select("conv_id", "h", "shared"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "digest", "chars")
    return lent.unionByName(own), convs.select("conv_id", "n_turns")


def shard_nodes(rows: pa.Table, segment: int = SEGMENT) -> Iterator[dict]:
    """The nodes of one (shard, segment): rows (conv_id, pos, x1, x2, chars), with a row at pos -1 for every conversation.

    That row holds the node where the segment starts and, as chars, the conversation's number of turns.
    """
    seg, shard = rows.column("seg")[0].as_py(), rows.column("shard")[0].as_py()
    columns = [rows.column(c).to_pylist() for c in ("conv_id", "pos", "x1", "x2", "chars")]
    convs = sorted({c for c, p in zip(columns[0], columns[1], strict=True) if p < 0})
    number = {c: k for k, c in enumerate(convs)}
    posting: dict[tuple, int] = {}  # (position, turn): bitset of conversations
    turn: list[dict[int, tuple]] = [{} for _ in convs]
    chars: dict[tuple, int] = {}
    starts: dict[tuple, int] = {}
    ending: dict[int, int] = {}  # depth: bitset of conversations with so many turns
    for c, pos, x1, x2, n in zip(*columns, strict=True):
        k = number[c]
        if pos < 0:
            starts[x1, x2] = starts.get((x1, x2), 0) | 1 << k
            ending[n] = ending.get(n, 0) | 1 << k
        else:
            posting[pos, x1, x2] = posting.get((pos, x1, x2), 0) | 1 << k
            chars[pos, x1, x2] = n
            turn[k][pos] = (x1, x2)

    def node(key: tuple, parent: tuple, depth: int, members: int, size: int) -> dict:
        ends, at = [], members & ending.get(depth, 0)
        while at:
            ends.append(convs[(at & -at).bit_length() - 1])
            at &= at - 1
        return {"k1": key[0], "k2": key[1], "p1": parent[0], "p2": parent[1], "depth": depth, "conv_id": convs[(members & -members).bit_length() - 1], "n_convs": members.bit_count(), "chars": size, "shard": shard, "ends": ends}

    last = segment * (seg + 1)
    stack = [(key, segment * seg, members) for key, members in starts.items()]
    if seg == 0:
        yield from (node(key, (None, None), 0, members, 0) for key, members in starts.items())
    while stack:
        key, depth, members = stack.pop()
        left = members
        while left:
            low = left & -left
            step = turn[low.bit_length() - 1].get(depth)
            if step is None:  # the conversation ends here
                left ^= low
                continue
            child = left & posting[depth, *step]
            left &= ~child
            at = (key[0] ^ step[0], key[1] ^ step[1])
            yield node(at, key, depth + 1, child, chars[depth, *step])
            if depth + 1 < last:
                stack.append((at, depth + 1, child))


def _shards(turns: DataFrame, convs: DataFrame, width: int, segment: int) -> DataFrame:
    """The nodes of all shards; a node that several shards have is a row of each."""
    seg, shard = F.floor(F.col("pos") / segment), F.floor(F.col("conv_id") / width)
    step = stored(turns.select(shard.alias("shard"), seg.alias("seg"), "conv_id", "pos", F.xxhash64("pos", "digest").alias("x1"), F.xxhash64("digest", "pos", F.lit("second")).alias("x2"), "chars"), "steps")
    first = convs.select(shard.alias("shard"), F.lit(0).cast("long").alias("seg"), "conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), F.col("n_turns").alias("chars"))
    # Segments after the first start at the XOR of all before.
    long = step.join(convs.where(F.col("n_turns") > segment), "conv_id").groupBy("shard", "conv_id", "n_turns", "seg").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    upto = Window.partitionBy("conv_id").orderBy("seg")
    later = long.select("shard", (F.col("seg") + 1).alias("seg"), "conv_id", F.lit(-1).cast("long").alias("pos"), F.bit_xor("x1").over(upto).alias("x1"), F.bit_xor("x2").over(upto).alias("x2"), F.col("n_turns").alias("chars")).where(F.col("seg") * segment < F.col("chars"))
    rows = reduce(DataFrame.unionByName, [step, first, later])
    schema = pa.schema([(f, pa.list_(pa.int64()) if f == "ends" else pa.int64()) for f in (c.split()[0] for c in NODE.split(", "))])

    def nodes(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(shard_nodes(table, segment)), schema=schema)

    return rows.groupBy("shard", "seg").applyInArrow(nodes, NODE)


def _ends(parts: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of every node where a conversation ends; pieces of a list pass one after the other."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                piece = ",".join(map(str, ids)).encode()
                if key == (k1, k2):
                    digest.update(b"," + piece)
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(piece)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True) if done else [(), (), ()], schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, digest.hexdigest()), schema, strict=True)], schema=schema)

    pieces = parts.where(F.size("ends") > 0).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard").select("k1", "k2", "ends")
    return pieces.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _path_totals(nodes: DataFrame) -> DataFrame:
    """conv_id, parent, attached, leaves, saved: every path with where it hangs, and the sums of all that hangs on it too.

    Pointer doubling: after round k a path's sums hold all paths fewer than 2^k steps below it.
    """
    top = F.min_by(F.struct("parent_conv_id", "depth"), "depth").alias("top")
    paths = nodes.groupBy("conv_id").agg(top, F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    now = stored(paths.select("conv_id", F.col("top.parent_conv_id").alias("parent"), (F.col("top.depth") - 1).alias("attached"), F.col("top.parent_conv_id").alias("up"), "leaves", "saved"), "paths")
    while now.where("up is not null").limit(1).count():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = now.where("up is not null").select(F.col("conv_id").alias("via"), F.col("up").alias("next"))
        added = now.join(below, "conv_id", "left").select("conv_id", "parent", "attached", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        hung, free = added.where("up is not null"), added.where("up is null")
        now = stored(hung.join(above, hung["up"] == above["via"], "left").select("conv_id", "parent", "attached", F.col("next").alias("up"), "leaves", "saved").unionByName(free.select("conv_id", "parent", "attached", "up", "leaves", "saved")), "paths")
    return now


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """Every node of the trie: turns (conv_id, pos, digest, chars) and conversations (conv_id, n_turns), turnless ones too.

    conv_id is the smallest member, parent_conv_id that of the parent, n_convs the members, n_leaves the childless nodes of
    the subtree, saved_tokens what a cache of common beginnings saves in it: (n_convs - 1) x characters of each node's last text.
    """
    ready(turns.sparkSession)
    parts = stored(_shards(turns, convs, shard, segment), "shards")
    merged = parts.groupBy("k1", "k2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("chars").alias("chars"))
    children = merged.groupBy("p1", "p2").agg(F.count("*").alias("n_children")).where("p1 is not null").withColumnsRenamed({"p1": "k1", "p2": "k2"})
    known = stored(merged.join(children, ["k1", "k2"], "left").join(_ends(parts), ["k1", "k2"], "left"), "nodes")
    parents = known.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    own = [F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")]
    below_root = known.where("p1 is not null").join(parents, ["p1", "p2"], "left")
    nodes = stored(below_root.unionByName(known.where("p1 is null").withColumn("parent_conv_id", F.lit(None).cast("long"))).select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), *own, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "tree")
    paths = _path_totals(nodes)
    hung = paths.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("attached").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    seg = F.floor(F.col("depth") / segment)
    full = nodes.join(hung, ["conv_id", "depth"], "left").withColumn("seg", seg).withColumn("leaf", F.col("leaf") + F.coalesce("hung_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("hung_saved", F.lit(0)))
    deeper = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    segs = full.groupBy("conv_id", "seg").agg(F.sum("leaf").alias("seg_leaf"), F.sum("saved").alias("seg_saved"))
    segs = segs.select("conv_id", "seg", F.coalesce(F.sum("seg_leaf").over(deeper), F.lit(0)).alias("rest_leaf"), F.coalesce(F.sum("seg_saved").over(deeper), F.lit(0)).alias("rest_saved"))
    here = Window.partitionBy("conv_id", "seg").orderBy(F.col("depth").desc())
    summed = full.withColumns({"in_leaf": F.sum("leaf").over(here), "in_saved": F.sum("saved").over(here)}).join(segs, ["conv_id", "seg"])
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("in_leaf") + F.col("rest_leaf")).alias("n_leaves"), (F.col("in_saved") + F.col("rest_saved")).alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame, rebuild: bool = False, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text); ``rebuild`` first gives families common beginnings."""
    turns = turns_of(conversations)
    return trie(*(rebuilt(turns) if rebuild else as_they_are(turns)), shard, segment)
