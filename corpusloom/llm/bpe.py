"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A word's encoding is found left to right: for every prefix, the last token of the prefix's encoding is the one
vocabulary token that ends there and may follow the last token of the shorter prefix. "May follow" depends on the two
tokens only, so the state of a prefix is one token id. Words are inserted into a trie by sorting them; the walk over the
sorted words is the depth-first traversal, its stack holds the last token of every prefix on the current path, and a
prefix shared by many words is computed once. A word's ids are read off its path from the end, so memory and time are
linear in its length.

Spark deals the documents; each task keeps a bounded cache from text chunks to ids, fills it with one traversal per
slice of documents, and needs no shuffle. The tokenizer file's path is a parameter and the file must be readable on
every executor.

Null text: as an empty one (no tokens). The special token's string in a text becomes its id, as the tokenizers library
does by default. Repeated rows each give a row, an empty table none; columns besides doc_id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_documents

#: Fixed value: the public pattern that splits text before the merges.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Chunks whose pieces never cross into the next chunk, as long as all white space is one of these four.
CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space (by any library's count) besides those four, as code points.
OTHER_SPACE = re.compile("[" + "".join(map(chr, [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
#: A text without these can be cut at every single space: no run of white space is torn.
UNEVEN_SPACE = re.compile(OTHER_SPACE.pattern[:-1] + "\t\r]|  | \n")
#: Chunks that a worker keeps (and 5/6 as many pieces, 5/3 as many token pairs), at some 700 bytes a chunk for all three.
#: A full cache keeps what it has (frequent chunks come early) and forgets a slice's new ones.
CACHE = 600_000
#: Longer chunks and pieces (in characters, bytes) are not kept.
LONG = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Found(dict):
    """Known chunks; one that is not known is noted in ``missed`` and stands for no ids until it is filled in."""

    def __init__(self) -> None:
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, key: str) -> bytes:
        self.missed.append(key)
        return b""


class TrieBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        raw = {s: bytes(alphabet[c] for c in s) for s in model["vocab"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for s, i in model["vocab"].items():
            self.bytes_of[i] = raw[s]
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.merge: dict[tuple[int, int], int] = {}  # (left, right) -> rank
        parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, whole = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            self.merge[a, b] = rank
            parts.setdefault(whole, (a, b, rank))
        never = len(model["merges"]) + 1
        # Edges of a token while it is being merged: (token, rank at which it is used up), outermost last.
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        for i in model["vocab"].values():
            for edge, side in ((self.right_edge, 1), (self.left_edge, 0)):
                chain, at, until = [], i, never
                while True:
                    chain.append((at, until))
                    if at not in parts:
                        break
                    until, at = parts[at][2], parts[at][side]
                edge[i] = chain
        self.cache = CACHE
        self.pairs: dict[int, bool] = {}
        ok = {i for i in model["vocab"].values() if i not in parts and len(self.bytes_of[i]) == 1}
        for i in sorted(parts, key=lambda x: parts[x][2]):
            a, b, rank = parts[i]
            if a in ok and b in ok and not self._crosses(a, b, rank):
                ok.add(i)
        self.token = {self.bytes_of[i]: i for i in ok}
        self.reach: dict[bytes, int] = {}  # last two bytes -> length of the longest token that ends so
        for t in self.token:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 0), len(t))
        self.chunks, self.spaced = Found(), Found()  # chunk -> ids; the second without the space before it
        self.pieces: dict[bytes, bytes] = {}
        self.packed = [int(i).to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.array_of = np.array(self.bytes_of, dtype=object)

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether some merge across the border of a and b happens earlier than rank ``before``.

        An edge token of a can merge until it is used up inside a; at equal rank the place further left goes first.
        """
        for x, x_until in self.right_edge[a]:
            for y, y_until in self.left_edge[b]:
                rank = self.merge.get((x, y))
                if rank is not None and rank < before and rank < x_until and rank <= y_until:
                    return True
        return False

    def encode_pieces(self, pieces: set[bytes]) -> None:
        """Depth-first walk over the trie of these pieces (their sorted order); fills the cache."""
        token, pairs, packed, reach, crosses = self.token.get, self.pairs, self.packed, self.reach.get, self._crosses
        if len(pairs) > self.cache * 5 // 3:
            pairs.clear()
        path: list[int] = []  # last token of the encoding of each prefix on the current path
        size = list(map(len, self.bytes_of))
        prior = b""
        for word in sorted(pieces):
            shared, most = 0, min(len(prior), len(word))
            if most > LONG and prior[:most] == word[:most]:
                shared = most
            while shared < most and prior[shared] == word[shared]:
                shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word) + 1):
                start = end - reach(word[end - 2 : end] if end > 1 else word[:1], 1)
                for start in range(start if start > 0 else 0, end):
                    t = token(word[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        path.append(t)
                        break
                    pair = path[start - 1] << 20 | t
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = not crosses(pair >> 20, t, 1 << 30)
                    if fits:
                        path.append(t)
                        break
                else:
                    raise ValueError("a prefix has no encoding: the vocabulary lacks a byte")
            end = len(word)
            t = path[end - 1]
            if size[t] == end:
                self.pieces[word] = packed[t]
            else:
                ids = []
                while end:
                    t = path[end - 1]
                    ids.append(packed[t])
                    end -= size[t]
                self.pieces[word] = b"".join(ids[::-1])
            prior = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunk, spaced = self.chunks.__getitem__, self.spaced.__getitem__
        cut, out, again = [self._cut(t) for t in texts], [], []
        for k, (first, rest) in enumerate(cut):
            missed = len(self.chunks.missed) + len(self.spaced.missed)
            out.append(b"".join(map(chunk, first)) + b"".join(map(spaced, rest)))
            if len(self.chunks.missed) + len(self.spaced.missed) > missed:
                again.append(k)
        added = self._fill()
        for k in again:
            out[k] = b"".join(map(chunk, cut[k][0])) + b"".join(map(spaced, cut[k][1]))
        full = len(self.chunks) + len(self.spaced) > self.cache
        for known, c in added:
            if full or len(c) > LONG:
                del known[c]
        return out

    def _fill(self) -> list[tuple[Found, str]]:
        """Encode every chunk that was asked for and not known, with one traversal; says what it added."""
        todo = []
        for known, before in ((self.chunks, ""), (self.spaced, " ")):
            todo += [(known, c, [self.special[c]] if c in self.special and not before else [p.encode() for p in PIECE.findall(before + c)]) for c in dict.fromkeys(known.missed)]
            known.missed = []
        new = {p for _, _, ps in todo for p in ps if not isinstance(p, int) and p not in self.pieces}
        self.encode_pieces(new)
        found = self.pieces
        for known, c, ps in todo:
            known[c] = b"".join([self.packed[p] if isinstance(p, int) else found[p] for p in ps])
        full = len(found) > self.cache * 5 // 6
        for p in new:
            if full or len(p) > LONG:
                del found[p]
        return [(known, c) for known, c, _ in todo]

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks as they stand, and chunks that follow a single space."""
        special = self.special and any(s in text for s in self.special)
        if not special and not UNEVEN_SPACE.search(text):
            rest = text.split(" ")
            return rest[:1], rest[1:]
        out: list[str] = []
        for s in self.split_special.split(text) if special else [text]:
            if s in self.special or OTHER_SPACE.search(s):
                out.append(s)  # white space of another kind: all of it is one chunk
            else:
                out += CHUNK.findall(s)
        return out, []

    def decode(self, ids: bytes) -> str:
        return b"".join(self.array_of[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


_loaded: dict[str, TrieBPE] = {}


def load(path: str, cache: int = CACHE) -> TrieBPE:
    """One encoder a Python worker: later tasks of the worker find its caches filled."""
    if path not in _loaded:
        _loaded[path] = TrieBPE(path)
    _loaded[path].cache = cache
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian u32) of every whole text."""

    def rows(ids: list, texts: list[str]) -> dict:
        coded = load(path).encode(texts)
        return {"doc_id": ids, "n_tokens": [len(c) // 4 for c in coded], "ids": coded}

    return map_documents(docs, rows, "doc_id long, n_tokens long, ids binary", text)


def round_trip(docs: DataFrame, path: str, text: str = "text", cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text; the ids never leave the task."""

    def rows(ids: list, texts: list[str]) -> dict:
        bpe = load(path, cache)
        coded = bpe.encode(texts)
        return {
            "doc_id": ids,
            "n_tokens": [len(c) // 4 for c in coded],
            "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded],
        }

    return map_documents(docs, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text)
