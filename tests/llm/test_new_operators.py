"""Token counts against the library, the prefix trie and the periodic runs against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import periodic_runs, prefix_trie, queries, token_counts

SCHEMA = "doc_id long, text string, word string, row long, tokens string, n_convs long"
ODD = [
    "", None, " ", "  a  b\n c ", "\n", "\n\n  x\t\ty ▁▁ z", "<s>a</s><unk>", "日本語 テキスト 😀😀", "é \x00\x1f\x0b\x0c\r", "x" * 5000, "ab" * 500 + " " * 100 + "z", "ﬁ ① Ａ", "　a b",
    "word " * 3000, "one", "a b c " * 9, "same same same same same same end", "\xa0a\xa0b", "tab\there\r\nend \x1c \x85",
]


def frame(spark, texts):
    rows = [(i, t, "w", 7, "t", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id here", None, None, None, None)] if rows else [], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rng = random.Random(1)
    noise = ["".join(rng.choice("abc thein  \n\t\xa0é😀'▁日本<s>123.#\x0b") for _ in range(rng.randrange(200))) for _ in range(100)]
    return [*noise, *(r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).collect()), *ODD]


@pytest.mark.parametrize("head", [token_counts.HEAD, 50, 0])
def test_token_counts_equal_the_library(spark, texts, head):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = frame(spark, texts)
    got = sorted((tuple(r) for r in token_counts.count_tokens(df, path, limit=40, head=head).collect()), key=repr)
    want = []
    for r in df.select("doc_id", "text").collect():
        t = r["text"] or ""
        n = len(model.encode(t))
        want.append((r["doc_id"], len(t.encode()), n, n > 40))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_pre_tokens_are_counted_once_each(spark, texts):
    path = queries.vocabulary("piece_bpe_32k.model")
    p = token_counts.Pieces(path)
    table = {r["word"]: (r["freq"], r["tokens"]) for r in token_counts.word_table(frame(spark, texts), path).collect()}
    assert sum(w.count("▁") * f for w, (f, _) in table.items()) == sum(t.count(" ") + t.count("▁") + 1 for t in [*texts, texts[-1], "no id here"] if t)
    assert table["▁word"][1] == 1 and table["\n"] == (table["\n"][0], 1)
    assert all(n == p.tokens([w])[0] for w, (_, n) in table.items())


def test_models_that_merge_over_blanks_are_refused(monkeypatch):
    p = token_counts.Pieces(queries.vocabulary("piece_bpe_32k.model"))
    p.check()
    p.__dict__["together"] = frozenset(["a▁"])
    with pytest.raises(ValueError, match="blank"):
        p.check()


def brute_trie(rows, rebuild):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [y[2] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 if rebuild else 0 for c in own}
    conv = {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members, children, below = defaultdict(list), defaultdict(list), {}
    for c in sorted(conv):
        for d in range(len(conv[c]) + 1):
            members[tuple(conv[c][:d])].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    out = []
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * len(s[-1][1]) if s else 0
        below[s] = (sum(below[k][0] for k in children[s]) or 1, saved + sum(below[k][1] for k in children[s]))
        ends = ",".join(str(c) for c in members[s] if len(conv[c]) == len(s))
        out.append((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(children[s]), *below[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("rebuild", "shard", "segment"), [(True, 500, 256), (True, 10, 3), (False, 100, 2)])
def test_trie_against_brute_force(spark, monkeypatch, rebuild, shard, segment):
    """Ties, repeated rows, null turns, roles, texts and ids, negative ids, a long conversation and copies of its beginning."""
    monkeypatch.setattr(prefix_trie, "BUCKET", 4)
    rng = random.Random(4)
    rows = [(c, rng.choice([None, k, k, k, 2]), rng.choice(["user", None]), rng.choice(["a", "bb", None, "ccc 日"])) for c in [*range(40), *range(100, 130), 205, -150, -100, -3, 10**12 + 1, *range(1000, 1060)] for k in range(rng.randrange(1, 9))]
    rows += [(c, k, "user", f"t{k % 3}") for c, n in ((50, 300), (51, 290), (150, 300)) for k in range(n)]
    rows += [*rows[:7], (None, 1, "u", "x")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, pos string, k1 long")
    got = prefix_trie.prefix_trie(df, rebuild, shard, segment)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == brute_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df, True).count() == 0 and prefix_trie.prefix_trie(df).count() == 0


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            run = w[i - q : j]
            if j > i and len(run) >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((i - q, len(run), q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 9))]
            w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        assert periodic_runs.runs_of(*periodic_runs.numbered([w])) == brute_runs(w)


def described(doc_id, text):
    w = periodic_runs.words_of(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark, sf_dir, texts):
    df = frame(spark, [t for t in texts if t is None or len(t) < 6000])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r[c] for c in names) for r in periodic_runs.find_runs(df, repeat=True).collect()), key=repr)
    assert got == sorted((described(r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert sum(r[1] > 0 for r in got) > 10 and periodic_runs.find_runs(df.limit(0)).count() == 0


def test_collapsed_texts(spark):
    df = frame(spark, ["head " + "a b c " * 9 + "tail", "no  run\there", None, "x " * 8])
    assert [(r["doc_id"], r["text"], r["n_convs"]) for r in periodic_runs.collapse_runs(df).collect()] == [(0, "head a b c tail", 1), (1, "no  run\there", 1), (2, None, 1), (3, "x", 1), (3, "x", 1), (None, "no id here", None)]


def test_runs_of_a_very_long_text():
    """Half a million words, one run; and half a million of two words: time stays near linear."""
    unit = [f"w{i}".encode() for i in range(1000)]
    assert periodic_runs.runs_of(*periodic_runs.numbered([unit * 500])) == [(0, 500_000, 1000)]
    rng = random.Random(2)
    assert len(periodic_runs.runs_of(*periodic_runs.numbered([[rng.choice(b"ab") for _ in range(500_000)]]))) > 1000


def test_rows_of_one_id_keep_their_own_lines(spark):
    """A line is cut from the row in which it repeats, not from the place of that number in another row of the id."""
    from corpusloom.llm import line_dedup

    same = "same line of a few words here"
    df = spark.createDataFrame([(1, f"alpha beta\n{same}"), (2, f"{same}\nkeep one"), (2, "unique first line of row two b\nkeep two"), (3, same)], "doc_id long, text string")
    got = sorted(r["text"] for r in line_dedup.drop_repeated_lines(df).collect())
    assert got == sorted([f"alpha beta\n{same}", "keep one", "unique first line of row two b\nkeep two"])


def test_pairs_of_a_crowd_leave_the_task_in_blocks(spark, monkeypatch):
    """Templated pages below the similarity: every candidate pair is given once it is found, and none is a copy."""
    from corpusloom.llm import simhash

    monkeypatch.setattr(simhash, "FRONTIER", 1000)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(120):
        ws = list(base)
        for p in rng.sample(range(300), 6):
            ws[p] = f"own{k}x{p}"
        texts.append((k, " ".join(ws)))
    df = spark.createDataFrame([*texts, (500, texts[7][1].replace("own7x", "other7x", 1))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5, 42).tolist()) for r in df.collect()}
    near = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert set(got) == near and 500 in near


def test_templates_of_a_user(spark):
    """Apostrophes and capitals in templates and labels, and no templates at all."""
    from corpusloom.llm import licenses

    df = spark.createDataFrame([(1, "This is the Author's own work, don't copy it."), (2, "MIT License"), (3, None)], "doc_id long, text string")
    own = [("author's \\ own", "the Author's own work don't copy it", "don't copy")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df, templates=own).collect()}
    assert got == {1: ("author's \\ own", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}
    none = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.scan_licenses(df, templates=[]).collect()}
    assert none == {1: ("", 0), 2: ("mit", 1), 3: ("", 0)}
    with pytest.raises(ValueError, match="key phrase"):
        licenses.build_index([("x", "some words", "")])


def test_long_rule_lists_are_joined(spark, monkeypatch):
    """By bytes, not by count alone: both ways give the same verdicts."""
    from corpusloom.llm import url_filter

    pages = spark.createDataFrame([(1, "http://a.long-host.example/x/y"), (2, "https://b.example/"), (3, None)], "page_id long, url string")
    rules = spark.createDataFrame([("long-host.example", "/x/", "block"), ("example", "/", "allow")], "host string, path string, verdict string")
    joined = []
    own = url_filter._by_join
    monkeypatch.setattr(url_filter, "_by_join", lambda *a: joined.append(1) or own(*a))
    short, long = (sorted(map(tuple, url_filter.filter_urls(pages, rules, max_bytes=b).collect()), key=repr) for b in (1 << 20, 10))
    assert short == long and joined == [1]
