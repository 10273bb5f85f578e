"""SimHash near-duplicates through a binary trie self-join.

A text's fingerprint has a bit for every bit position that is set in over half of its shingle hashes. Fingerprints that
differ in at most ``budget`` bits are linked and the connected groups are returned.

Plan. Exact copies share a fingerprint, so the join works on distinct fingerprints (a map-side combined aggregation: a
group of copies of any size is one row). Cut into budget + 1 blocks of bits, two linked fingerprints agree on one whole
block, so rows are dealt by (block, value); a block value that still holds over ``limit`` fingerprints is dealt again by
blocks of its remaining bits. A task sorts its fingerprints - the sorted order is the binary trie - and walks pairs of
trie nodes level by level, adding the bits in which they differ and dropping a pair as soon as it is over the budget.
All pairs of a level are one numpy step; a frontier that grows is cut in slices, so memory is bounded. A task then keeps
a spanning forest of its links: as good as all of them for the groups, at most one link a fingerprint and task, so a
group of near copies never makes the square of its size. Components come from rounds of minimum propagation with pointer
jumping over tables in the shared folder.

Two uses: :func:`group_documents` joins one 64-bit fingerprint within 2 bits. :func:`drop_near_copies` looks for a
shingle similarity of 0.8, at which 64-bit fingerprints differ in about ten bits, too many to prune by. It takes 512 bits
or more of the distinct shingles and walks several tries over a few of them each; how many tries, how many bits each and
with which budget follows from the number of rows (:func:`near_plan`), so that chance meetings stay a constant number a
row. Pairs that differ in no more of all bits than a similarity of 0.8 makes likely are candidates. Candidates are joined
back to their shingle sets (as 64-bit hashes), and only pairs with a Jaccard similarity of 0.8 or more are links.

Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id are one document
with several rows: each is returned with its own fingerprint and its group's smallest doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_documents, remove, stored
from corpusloom.shipping import ready

WIDTH = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A block value with more distinct fingerprints is dealt again by more bits; rows of one numpy walk; pairs of a step.
LIMIT, WALK, FRONTIER = 200_000, 1 << 18, 1 << 20
#: Leaves of up to so many rows are compared row by row; in larger ones rows that are connected already are not compared.
#: A key with more candidate pairs a row than DENSE gives one pair a row at first.
FEW, DENSE = 4, 4


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words if there are fewer; nothing without words."""
    ws = text.encode().translate(LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(start.tolist(), end, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles (a finalizer over the salted hash)."""
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, count: int = 1, text: str = "text") -> DataFrame:
    """doc_id and f0 (the 64 bits as a signed long) of every row; with ``count`` more of them from mixed hashes, f1, f2, ..."""

    def rows(ids: list, texts: list[str]) -> dict:
        hashes = [shingle_hashes(t, words, seed) for t in texts]
        out: dict = {"doc_id": ids}
        for k in range(count):
            out[f"f{k}"] = np.array([fingerprint(mix(h, k) if k else h) for h in hashes], np.uint64).view(np.int64)
        return out

    return map_documents(docs, rows, ", ".join(["doc_id long", *(f"f{k} long" for k in range(count))]), text)


def blocks(width: int, budget: int) -> list[tuple[int, int]]:
    """(shift, bits) of budget + 1 blocks that cover ``width`` bits, from the low end."""
    cuts = [round(i * width / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def walk(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of ``values`` (``width`` bits) within the budget, inside each of the groups [start, end).

    ``values`` is sorted within groups and each is there once a group. A trie node is a range of equal leading bits; a frontier row is a pair of nodes
    with the bits in which their prefixes differ. A node paired with itself stands for the pairs inside it.
    """
    ones = np.zeros((width, len(values) + 1), np.int32)
    for level in range(width):
        np.cumsum((values >> np.uint64(level)) & np.uint64(1), out=ones[level, 1:])
    many = ends - starts > 1
    todo = [(width - 1, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64))]
    while todo:
        level, a0, a1, b0, b1, diff = todo.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            todo += [(level, *(x[half:] for x in (a0, a1, b0, b1, diff))), (level, *(x[:half] for x in (a0, a1, b0, b1, diff)))]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():  # the rest of the bits at once
            x, y = a0[leaf], b0[leaf]
            low = np.uint64((1 << (level + 1)) - 1)
            near = diff[leaf] + np.bitwise_count((values[x] ^ values[y]) & low) <= budget
            yield x[near], y[near]
            a0, a1, b0, b1, diff = (v[~leaf] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        one = ones[level]
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])  # first index whose bit is 1
        same = a0 == b0
        parts = []
        for p0, p1, q0, q1, more, allowed in ((a0, am, b0, bm, 0, True), (am, a1, bm, b1, 0, True), (a0, am, bm, b1, 1, True), (am, a1, b0, bm, 1, ~same)):
            ok = (p1 > p0) & (q1 > q0) & (diff + more <= budget) & allowed & ~((p0 == q0) & (p1 - p0 == 1))
            parts.append((p0[ok], p1[ok], q0[ok], q1[ok], diff[ok] + more))
        todo.append((level - 1, *(np.concatenate(c) for c in zip(*parts, strict=True))))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): every member with the smallest of its group."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def members_of(rows: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a member of leaf a[k] and a member of leaf b[k], as row numbers."""
    n = size[a] * size[b]
    pair = np.repeat(np.arange(len(a)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return rows[first[a][pair] + at // size[b][pair]], rows[first[b][pair] + at % size[b][pair]]


def _bits(word: Column, shift: int, n: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))


def deal(prints: DataFrame, tables: list[tuple[int, int, int]], budget: int, limit: int = LIMIT) -> DataFrame:
    """The rows of ``prints`` under every key (key, t) by which a partner may be met; t is the table.

    A table (word, shift, bits) is joined by budget + 1 blocks. A key with over ``limit`` rows is replaced by keys that
    add a block of the table's remaining bits, and one that is still too large by pairs of salts.
    """
    columns = prints.columns

    def dealt(df: DataFrame, t: int, tag: list[Column], value: Column, width: int) -> DataFrame:
        keys = [F.xxhash64(*tag, F.lit(k), _bits(value, s, n)) for k, (s, n) in enumerate(blocks(width, budget))]
        numbered = F.array(*[F.struct(F.lit(k).alias("k"), key.alias("key")) for k, key in enumerate(keys)])
        return df.select(*columns, F.lit(t).alias("t"), F.explode(numbered).alias("e")).select(*columns, "t", "e.k", "e.key")

    parts = [dealt(prints, t, [F.lit(t)], _bits(F.col(f"f{w}"), s, n), n) for t, (w, s, n) in enumerate(tables)]
    first = parts[0]
    for p in parts[1:]:
        first = first.unionAll(p)
    crowded = stored(_over(first, limit).select("key"), "crowded")
    if crowded.isEmpty():
        return first.select(*columns, "t", "key")
    calm = first.join(crowded, "key", "left_anti").select(*columns, "t", "key")
    hot = first.join(crowded, "key", "left_semi")
    finer = None
    for t, (w, s, n) in enumerate(tables):
        for k, (shift, size) in enumerate(blocks(n, budget)):
            value = _bits(F.col(f"f{w}"), s, n)
            above = F.shiftleft(F.shiftrightunsigned(value, shift + size), shift) if shift + size < 64 else F.lit(0).cast("long")
            rest = above.bitwiseOR(_bits(value, 0, shift)) if shift else above
            mine = hot.where((F.col("t") == t) & (F.col("k") == k))
            keys = [F.xxhash64("key", F.lit(j), _bits(rest, s2, n2)) for j, (s2, n2) in enumerate(blocks(n - size, budget))]
            more = mine.select(*columns, "t", F.explode(F.array(*keys)).alias("key"))
            finer = more if finer is None else finer.unionAll(more)
    return calm.unionAll(salted(finer, limit))


def _over(keyed: DataFrame, limit: int) -> DataFrame:
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def salted(keyed: DataFrame, limit: int) -> DataFrame:
    """Keys with over ``limit`` rows cut into pairs of salts, about ``limit`` rows a salt: every two rows of the key still
    meet, in tasks of bounded size. Other keys stay as they are."""
    large = stored(_over(keyed, limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("_salts")), "large-keys")
    if large.isEmpty():
        return keyed
    mine = F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    spread = keyed.join(large, "key").withColumn("_mine", mine).withColumn("_other", other)
    named = spread.withColumn("key", F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other"))).select(*keyed.columns)
    return keyed.join(large.select("key"), "key", "left_anti").select(*keyed.columns).unionAll(named)


def cross(x: np.ndarray, y: np.ndarray, label: np.ndarray, step: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a member of x and one of y whose labels differ, in bounded blocks; x is y for the pairs inside one leaf."""
    of_x, of_y = label[x], label[y]
    for name in np.unique(of_x):
        i, j = x[of_x == name], y[of_y > name] if x is y else y[of_y != name]
        if len(j):
            per = max(1, step // len(j))
            for at in range(0, len(i), per):
                part = i[at : at + per]
                yield np.repeat(part, len(j)), np.tile(j, len(part))


def _differing(words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for x in words:
        out += np.bitwise_count(x[i].view(np.uint64) ^ x[j].view(np.uint64))
    return out


def _leaves(key: np.ndarray, t: np.ndarray, words: list[np.ndarray], tables: list[tuple[int, int, int]], budget: int) -> Iterator[tuple]:
    """For every table: its rows (one leaf after the other), first and size of each leaf, and the leaf pairs that meet.

    A leaf's rows share a key and the table's bits. Leaves of several rows meet themselves.
    """
    for table in np.unique(t):
        w, shift, width = tables[table]
        mine = np.flatnonzero(t == table)
        value = (words[w][mine].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        order = np.lexsort((value, key[mine]))
        mine, value = mine[order], value[order]
        k = key[mine]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (value[1:] != value[:-1])]))
        size = np.diff(np.append(first, len(k)))
        leaf_key = k[first]
        cut = np.flatnonzero(np.concatenate([[True], leaf_key[1:] != leaf_key[:-1]]))
        several = np.flatnonzero(size > 1)

        def met(value: np.ndarray = value[first], cut: np.ndarray = cut, several: np.ndarray = several) -> Iterator[tuple]:
            yield several, several
            yield from walk(value, cut, np.append(cut[1:], len(value)), budget, width)

        yield mine, first, size, met()


def _join(spread: DataFrame, links: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``links`` over the rows of whole keys, a bounded number of rows at a time; rows come in the order of key and id."""
    n = int(ready(spread.sparkSession).conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size > WALK:  # rows come sorted by key: whole groups can go, the last one may go on
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                done = rows[0] != rows[0][-1]
                if done.any():
                    yield from links([r[done] for r in rows])
                held, size = [[r[~done] for r in rows]], int((~done).sum())
        if size:
            yield from links([np.concatenate(c) for c in zip(*held, strict=True)])

    return spread.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(join, schema)


def trie_links(prints: DataFrame, tables: list[tuple[int, int, int]] = [(0, 0, WIDTH)], budget: int = 2, total: int | None = None, limit: int = LIMIT) -> DataFrame:  # noqa: B006
    """Spanning links (a, b) between the ids of ``prints`` (id, f0, f1, ...).

    A pair is met when one table's bits differ by ``budget`` at most, and linked when all bits differ by ``total`` at most.
    Rows with the same bits of a table are one leaf. In large leaves the first row takes all it is near to, the first of the
    rest likewise, until none is left; then all members that are not connected yet are compared, so no link that would
    connect two groups is left out.
    """
    n_words, total = len(prints.columns) - 1, budget if total is None else total

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, words = rows[2], rows[3:]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        top = np.arange(len(ids))

        def roots(i: np.ndarray) -> np.ndarray:
            r = top[i]
            while (top[r] != r).any():
                r = top[r]
            return r

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            near = (_differing(words, i, j) <= total) & (i != j)
            if near.any():
                i, j = forest(i[near], j[near])
                found.append((ids[i], ids[j]))
                while (apart := roots(i) != roots(j)).any():
                    i, j = i[apart], j[apart]
                    a, b = roots(i), roots(j)
                    np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
                if len(found) > 64:
                    found[:] = [forest(*(np.concatenate(c) for c in zip(*found, strict=True)))]

        for mine, first, size, met in _leaves(rows[0], rows[1], words, tables, budget):
            for a, b in met:
                few = size[a] * size[b] <= FEW * FEW
                keep(*members_of(mine, first, size, a[few], b[few]))
                for x, y in zip(a[~few].tolist(), b[~few].tolist(), strict=True):
                    here = mine[first[x] : first[x] + size[x]]
                    there = here if x == y else mine[first[y] : first[y] + size[y]]
                    left = here if x == y else here[:0]
                    while len(left):
                        keep(np.full(len(left), left[0]), left)
                        left = left[roots(left) != roots(left[:1])]
                    label = np.zeros(len(ids), np.int64)
                    label[here], label[there] = roots(here), roots(there)
                    for i, j in cross(here, there, label):
                        apart = roots(i) != roots(j)
                        keep(i[apart], j[apart])
        if not found:
            return
        a, b = forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _join(deal(prints, tables, budget, limit).select("key", "t", "id", *(f"f{k}" for k in range(n_words))), links, "a long, b long")


def trie_pairs(prints: DataFrame, tables: list[tuple[int, int, int]], budget: int, total: tuple[int, int], limit: int = LIMIT, crowded: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b, of ``prints`` (id, n, label, f0, f1, ...), met as in :func:`trie_links`.

    ``total`` bounds the differing bits, first of pairs with a set of up to four members, then of all others. Sets of n
    members can't have a similarity of 0.8 if their sizes are further apart than that, nor is a pair of one label asked
    for. Without ``crowded``, a key with over DENSE pairs a row gives one pair a row only, and a row (null, null, key) that
    names it: with ``crowded`` (key), these keys give every pair that is left between different labels.
    """
    names = [c for c in prints.columns if c not in ("id", "n", "label")]
    whole = crowded is not None

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, ids, n, label, words = rows[0], rows[2], rows[3], rows[4], rows[5:]
        keys, key_no = np.unique(key, return_inverse=True)
        dense = np.zeros(len(keys), bool)
        in_key = np.bincount(key_no)

        def accepted(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ok = (ids[i] != ids[j]) & (label[i] != label[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            d = _differing(words, i, j)
            near = d <= np.where(np.minimum(n[i], n[j]) <= 4, *total)
            return i[near], j[near], d[near]

        def thin(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """All pairs, but of a dense key the nearest of smaller row number for each row."""
            i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
            if whole:
                return i, j, d
            dense[np.bincount(key_no[i], minlength=len(keys)) > DENSE * in_key] = True
            much = dense[key_no[i]]
            x, y, e = np.minimum(i, j)[much], np.maximum(i, j)[much], d[much]
            order = np.lexsort((x, e, y))
            x, y, e = x[order], y[order], e[order]
            one = np.concatenate([[True], y[1:] != y[:-1]]) if len(y) else np.zeros(0, bool)
            return np.concatenate([i[~much], x[one]]), np.concatenate([j[~much], y[one]]), np.concatenate([d[~much], e[one]])

        def batch(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "key"])

        for mine, first, size, met in _leaves(key, rows[1], words, tables, budget):
            found = [(np.zeros(0, np.int64),) * 3]
            held = 0
            for a, b in met:
                few = size[a] * size[b] <= FEW * FEW
                af, bf = a[few], b[few]
                for at in range(0, len(af), FRONTIER // (FEW * FEW)):
                    part = slice(at, at + FRONTIER // (FEW * FEW))
                    found.append(accepted(*members_of(mine, first, size, af[part], bf[part])))
                    held += len(found[-1][0])
                for x, y in zip(a[~few].tolist(), b[~few].tolist(), strict=True):
                    here = mine[first[x] : first[x] + size[x]]
                    there = here if x == y else mine[first[y] : first[y] + size[y]]
                    if whole:
                        steps = cross(here, there, label)
                    else:  # all others wait for the links that these give
                        dense[key_no[here[0]]] = True
                        steps = iter([(np.full(len(there), here[0]), there), (here[:-1], here[1:])])
                    for i, j in steps:
                        found.append(accepted(i, j))
                        held += len(found[-1][0])
                        if whole and held > FRONTIER:
                            yield batch(*thin(found)[:2])
                            found, held = [(np.zeros(0, np.int64),) * 3], 0
                if held > FRONTIER:
                    if whole:  # nothing is thinned out, so pairs go on as they are found
                        yield batch(*thin(found)[:2])
                        found = [(np.zeros(0, np.int64),) * 3]
                    else:
                        found = [thin(found)]
                    held = 0
            yield batch(*thin(found)[:2])
        named = keys[dense]
        if len(named):
            none = pa.nulls(len(named), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(named, pa.int64())], names=["a", "b", "key"])

    spread = deal(prints, tables, budget, limit).select("key", "t", "id", "n", "label", *names)
    return _join(spread.join(crowded, "key", "left_semi") if whole else spread, links, "a long, b long, key long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected links (a, b) can reach.

    A round gives each node the least label among its neighbours (aggregated with map-side combine), then jumps: a
    label is replaced by its own label. Both joins are plain equi-joins that the engine may split when skewed. Labels
    are written to the shared folder every round, so lineage stays short and a lost executor costs one round at most;
    those of the round before are deleted. Rounds go on until no label changes.
    """
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    after = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")).select("node", F.lit(None).cast("long").alias("old"), "root"), "labels")
    while True:
        labels = after.select("node", "root")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        moved = lower.join(jump, F.col("low") == F.col("at"), "left").select("node", F.col("root").alias("old"), F.least("low", "beyond").alias("root"))
        before, after = after, stored(moved, "labels")
        remove(before)
        if after.where("root <> old").limit(1).isEmpty():
            remove(both)
            return after.select("node", "root")


def group_documents(docs: DataFrame, words: int = 3, budget: int = 2, seed: int = 42, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) for every row."""
    rows = stored(fingerprints(docs, words, seed, 1, text), "fingerprints")
    least = stored(rows.groupBy("f0").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(trie_links(least.select(F.col("f0").alias("id"), "f0"), budget=budget, limit=limit))
    owned = least.join(labels, least["f0"] == labels["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    group = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(owned.join(group, "root").select("f0", "component_id"), "groups")
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return rows.join(of, "f0").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: At a shingle similarity of 0.8 a bit differs with probability DIFFER (arccos of 2 * 0.8 / 1.8, over pi); with up to
#: four shingles, where ties weigh, with SMALL_DIFFER. Chance meetings that a row may have in one trie, the share of pairs
#: at 0.8 that some trie must meet, and by how many standard deviations a pair may differ in more bits than it does on average.
DIFFER, SMALL_DIFFER, CHANCE, RECALL, DEVIATIONS = 0.1515, 0.19, 64, 0.996, 4
#: Words that every fingerprint has at least, and the bits that a trie's pairs may differ in.
NEAR_WORDS, NEAR_BUDGET = 8, 2


def near_plan(rows: int, budget: int = NEAR_BUDGET) -> tuple[int, list[tuple[int, int, int]], int, tuple[int, int]]:
    """(words a fingerprint, tables, budget, bounds of differing bits) for a corpus of ``rows`` rows.

    A table gets the fewest bits with which a row meets at most CHANCE others by chance, and there are as many tables as it
    takes to meet a pair at 0.8 with probability RECALL: 20 bits and 11 tables for 200 thousand rows, 27 and 25 for 15 million.
    """
    ball = lambda width: sum(math.comb(width, i) for i in range(budget + 1))
    width = next(w for w in range(4 * (budget + 1), 65) if rows * ball(w) <= CHANCE * 2**w or w == 64)
    met = sum(math.comb(width, i) * DIFFER**i * (1 - DIFFER) ** (width - i) for i in range(budget + 1))
    count, each = math.ceil(math.log(1 - RECALL) / math.log(1 - met)), 64 // width
    words = max(NEAR_WORDS, -(-count // each))
    most = lambda p: round(p * 64 * words + DEVIATIONS * math.sqrt(64 * words * p * (1 - p)))
    return words, [(k // each, k % each * width, width) for k in range(count)], budget, (most(SMALL_DIFFER), most(DIFFER))


def shingle_sets(docs: DataFrame, words: int, seed: int, prints: int, text: str = "text") -> DataFrame:
    """doc_id and id (a hash of the distinct shingles) of every row; with ``prints`` n and so many f0, f1, ..., else the set itself."""
    names = [f"f{k}" for k in range(prints)]

    def rows(ids: list, texts: list[str]) -> dict:
        sets = [np.unique(shingle_hashes(t, words, seed)) for t in texts]
        out: dict = {"doc_id": ids, "id": np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64), "n": [len(s) for s in sets]}
        if not prints:
            return {**out, "shingles": [s.view(np.int64) for s in sets]}
        for k, name in enumerate(names):
            out[name] = np.array([fingerprint(mix(s, k) if k else s) for s in sets], np.uint64).view(np.int64)
        return out

    rest = [f"{name} long" for name in names] if prints else ["shingles array<long>"]
    return map_documents(docs, rows, ", ".join(["doc_id long, id long, n int", *rest]), text)


def similar(pairs: DataFrame, least: DataFrame, docs: DataFrame, words: int, seed: int, text: str = "text") -> DataFrame:
    """The pairs (a, b) of set ids whose shingle sets have a Jaccard similarity of 0.8 or more. Only their documents are read."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = least.join(ids, "id", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    sets = stored(shingle_sets(docs.select("doc_id", text).join(wanted, "doc_id", "left_semi"), words, seed, 0, text).dropDuplicates(["id"]).select("id", "shingles"), "shingle-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = stored(both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "similar")  # n / (a + b - n) >= 0.8
    remove(sets)
    return links


def near_links(docs: DataFrame, least: DataFrame, words: int, seed: int, plan: tuple, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Links (a, b) of set ids, each of similarity 0.8 or more, that connect what the candidates' links connect.

    Of crowded keys one pair a row is verified first; then every candidate pair whose rows these links leave apart.
    """
    names = [f"f{k}" for k in range(plan[0])]
    first = stored(trie_pairs(least.select("id", "n", F.col("id").alias("label"), *names), *plan[1:], limit), "candidates")
    links = similar(first.where("a IS NOT NULL").select("a", "b").distinct(), least, docs, words, seed, text)
    crowded = stored(first.where("key IS NOT NULL").select("key").distinct(), "crowded-keys")
    remove(first)
    if crowded.isEmpty():
        return links
    labels = components(links)
    labelled = least.join(labels, least["id"] == labels["node"], "left").select("id", "n", F.coalesce("root", "id").alias("label"), *names)
    more = stored(trie_pairs(labelled, *plan[1:], limit, crowded).select("a", "b").distinct(), "candidates")
    return links.unionAll(similar(more, least, docs, words, seed, text))


def near_copies(docs: DataFrame, words: int = 5, seed: int = 42, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id and component_id of every document that has a near copy with a smaller doc_id (five-word shingles, 0.8)."""
    plan = near_plan(docs.count())
    names = [f"f{k}" for k in range(plan[0])]
    rows = stored(shingle_sets(docs.where("doc_id IS NOT NULL"), words, seed, plan[0], text), "fingerprints")
    least = stored(rows.groupBy("id").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("n", *names))), "distinct-sets")
    labels = components(near_links(docs, least, words, seed, plan, limit, text))
    owned = least.join(labels, least["id"] == labels["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    group = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    of = owned.join(group, "root").select("id", "component_id")
    return rows.select("doc_id", "id").join(of, "id").where("doc_id <> component_id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """The documents without those that have a near copy of smaller doc_id: one of each group stays, all columns kept.

    Documents without a word are no one's copy and stay; a null doc_id cannot be named as a copy and stays.
    """
    texts = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    gone = stored(near_copies(texts, words, seed).select(F.col("doc_id").alias("_copy_id")).distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["_copy_id"], "left_anti")
