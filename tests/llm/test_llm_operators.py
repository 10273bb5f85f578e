"""The operators of the first rounds against brute force, libraries and planted cases, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpusloom.llm import bpe, decontaminate, licenses, line_dedup, quality_crf, quality_rules, queries, secrets, simhash, token_store, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, labels string"
ODD = [
    "", None, "one", "a b c a b c a b c", "x\ny\nx\n\n", "MIT License", "the  mit-license\nApache License, gpl", "naïve café ÉTÉ İ ß 日本語 😀", " \t\n\x0b ", "<|endoftext|> a<|endoftext|>",
    "word " * 3000, "The General Public License general public license", "tab\there\r\nend \x1c \x85 \xa0  z",
]


def frame(spark, texts, start=0):
    """Documents with clashing extra columns; the last row is there twice and one id is null."""
    rows = [(start + i, t, "en", f"src{i % 3}", None, "x", None, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id here", None, None, None, None, None, None)] if rows else [], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_licenses_against_brute_force(spark, docs):
    df = frame(spark, ODD + [r["text"] for r in docs.limit(60).collect()] + ["x y\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under cc by"])
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licenses(df).collect()), key=repr)
    want = []
    for i, t in texts_of(df):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for p, label in licenses.BASE for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        want.append((i, len(ws), len(at), min([k for k, _ in at], default=None), max([k for k, _ in at], default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=repr)


def test_licenses_method_labels(spark):
    rows = licenses.scan_licenses(frame(spark, ["x y\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under cc by", "All rights reserved.", "License"])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["labels"] for i in range(5)] == ["mit", "cc-by-nc", "", "reserved", ""]
    assert by[0]["score"] == 1.0 and 0 < by[1]["score"] <= 1 and by[2]["score"] == 0
    assert (by[1]["matches"][0]["label"], by[1]["matches"][0]["start"]) == ("cc-by-nc", 0)


def test_rules_against_brute_force(spark, docs):
    df = frame(spark, ODD + [r["text"] for r in docs.limit(60).collect()])
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.ledger(df).collect()), key=repr)
    want = []
    for i, t in texts_of(df):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        inside = {k + d for k, w in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if windows[w] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)))
    assert got == sorted(want, key=repr)


def test_policies_and_ablations(spark, docs):
    ledger = quality_rules.ledger(docs).cache()
    kept = {v: {r["doc_id"] for r in quality_rules.apply_policy(ledger, v).where("kept").collect()} for v in quality_rules.POLICIES}
    assert kept["v2"] < kept["v1"]
    for r in quality_rules.ablations(ledger, "v2").collect():
        others = [x for x in quality_rules.POLICIES["v2"] if x != r["rule"]]
        mask, bit = quality_rules.mask_of(others), quality_rules.mask_of([r["rule"]])
        rows = [x["failed"] for x in ledger.select("failed").collect()]
        assert r["n_failed"] == sum(bool(f & bit) for f in rows) and r["n_only"] == sum(bool(f & bit) and not f & mask for f in rows) and r["n_docs"] == len(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randrange(1, 9))], [rng.choice("abc") for _ in range(rng.randrange(0, 15))]
        best = min((distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1)), default=len(p))
        got = decontaminate.myers(p, t, 4)
        assert (got is None) == (min(best, len(p)) > 4 or not t) or got[0] == best


def test_decontamination_finds_edited_passages(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [r["text"] for r in items.orderBy("item_id").collect()]
    rng = random.Random(5)
    planted, clean = [], []
    for t in texts[:20]:
        ws = t.split()
        for _ in range(decontaminate.budget(len(decontaminate.words_of(t)))):
            ws[rng.randrange(len(ws))] = "edited"
        edited = " ".join(ws)
        planted.append("before it " + (edited if "ß" in edited else edited.upper()) + " after it")
        clean.append(" ".join(rng.sample(t.split(), len(t.split()))) + " other words")
    df = frame(spark, [*planted, *clean, "", None])
    found = decontaminate.find_items(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(i, i) for i in range(20)}
    assert not {r["doc_id"] for r in found} & set(range(20, 40))
    left = {r["doc_id"] for r in decontaminate.decontaminate(df, items).collect()}
    assert left == {*range(20, 42), None}
    blocks = decontaminate.find_items(df, items, block_bytes=1000).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))
    assert decontaminate.find_items(df, items.limit(0)).count() == 0 and decontaminate.find_items(df.limit(0), items).count() == 0
    assert decontaminate.decontaminate(df, items.limit(0)).count() == df.count() and decontaminate.decontaminate(df.limit(0), items).count() == 0
    several = {r["doc_id"] for r in decontaminate.decontaminate(df, items, block_bytes=1000).collect()}
    assert several == left


def test_items_of_one_id_and_short_items(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon y"), (2, "one two three four five six"), (3, "alpha"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta epsilon"), (7, "beta gamma delta epsilon y"), (8, "alpha"), (9, None), (None, "one two three four five")], "item_id long, text string")
    for size in (8, 1 << 20):
        assert sorted(map(tuple, decontaminate.find_items(docs, items, block_bytes=size).select("doc_id", "item_id", "distance", "n_places", "first_end", "last_end").collect())) == [(1, 7, 0, 2, 5, 6), (1, 8, 0, 1, 1, 1), (3, 8, 0, 1, 0, 0)]
        assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items, block_bytes=size).collect()} == {2, 3, 4}


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    rng = random.Random(1)
    noise = ["".join(rng.choice("abc thein  \n\xa0́é😀'sé\x1f\x0b<|") for _ in range(60)) for _ in range(60)]
    df = frame(spark, ODD + noise + [r["text"] for r in docs.limit(40).collect()])
    t = Tokenizer.from_file(path)
    rows = {}
    for i, x in texts_of(df):
        ids = t.encode(x, add_special_tokens=False).ids
        rows[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.round_trip(df, path).collect()
    assert len(got) == df.count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == rows[r["doc_id"]] for r in got)


def test_bpe_of_long_words_and_texts():
    """A word of 300,000 letters and a text of 4 MB equal the library's; memory stays linear."""
    import tracemalloc

    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(300_000)), "é" * 50_000, "word and more words here\n" * 160_000, "\x1f" + "a b\t" * 20_000]
    t, b = Tokenizer.from_file(path), bpe.TrieBPE(path)
    tracemalloc.start()
    got = b.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert peak < 400 << 20 and max(map(len, b.chunks), default=0) <= bpe.LONG and max(map(len, b.pieces)) <= bpe.LONG


def one_edit(a, b):
    return abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1


def brute_lines(rows):
    lines = []
    for i, t in rows:
        for k, raw in enumerate(t.split("\n")):
            ws = re.findall(r"[^\x20\x09-\x0D]+", raw)
            if i is not None and len(ws) >= line_dedup.MIN_WORDS:
                lines.append(((i, k), ws))
    lines.sort()
    firsts, out = {}, []
    for at, ws in lines:
        firsts.setdefault(tuple(ws), at)
    reps = sorted((at, list(ws)) for ws, at in firsts.items())
    near = {}
    for n, (at, ws) in enumerate(reps):
        if len(ws) >= line_dedup.NEAR_WORDS:
            near[at] = next((a for a, w in reps[:n] if len(w) >= line_dedup.NEAR_WORDS and one_edit(ws, w)), None)
    for at, ws in lines:
        first = firsts[tuple(ws)]
        if first < at:
            out.append((*at, "exact", *first))
        elif near.get(at):
            out.append((*at, "near", *near[at]))
    return sorted(set(out))


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 6, 10, 11, 14]))] for _ in range(25)]
    texts = ["", None]
    for _ in range(40):
        ls = []
        for _ in range(4):
            ws = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(ws))
                how = rng.randrange(3)
                ws[k : k + 1] = [] if how == 0 and len(ws) > 1 else ["new"] if how == 1 else [ws[k], rng.choice(words)]
            ls.append(rng.choice([" ", "  ", "\t"]).join(ws))
        texts.append("\n".join(ls))
    df = frame(spark, texts)
    got = sorted(map(tuple, line_dedup.repeated_lines(df).collect()))
    assert got == brute_lines([(r["doc_id"], r["text"] or "") for r in df.dropDuplicates(["doc_id"]).collect()])
    assert {r[2] for r in got} == {"exact", "near"}


def test_dropping_lines_keeps_the_rest(spark):
    line = "this line of ten words is in all the documents"
    df = spark.createDataFrame([(1, f"alpha\n{line}\nbeta", 9), (2, f"gamma\n{line}", 9), (3, line, 9), (4, "", 0), (5, None, None), (6, "short", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {1: (f"alpha\n{line}\nbeta", 9), 2: ("gamma", 5), 4: ("", 0), 5: (None, None), 6: ("short", 5)}
    assert line_dedup.repeated_lines(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, f"a b\n{line}", "x", "y", "z"), (2, f"{line}\nc d", "x", "y", "z"), (None, line, "x", "y", "z")], "doc_id long, text string, gone string, id string, row string")
    assert sorted((tuple(r) for r in line_dedup.drop_repeated_lines(clash).collect()), key=repr) == sorted([(1, f"a b\n{line}", "x", "y", "z"), (2, "c d", "x", "y", "z"), (None, line, "x", "y", "z")], key=repr)


def test_urls_longest_match(spark):
    urls = ["http://a.example.net/en/x", "http://a.example.net/de/", "https://Foo.ORG/fr/1?x=/y", "http://x.example.com/de/1", "http://x.example.com/de", "http://net", "http://net/", None, "", "no scheme", "http://spam-farm.example.org/en/", "ftp://u.v.org/fr/#a://b", "http://casino.io?x", "http://example.network/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow"), ("example.com/de/", "block"), (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("org/fr/", "allow"), (None, "block"), (None, "allow")]
    joined = [(r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, max_rules=2).orderBy("page_id").collect()]
    assert joined == got and url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, rules.limit(0)).count() == len(urls)
    partial = spark.createDataFrame([("net", "/e", "allow"), ("net", "/en", "block"), ("net", "/en", "allow")], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, partial).where("page_id = 0").first()["verdict"] == "block"
    assert url_filter.filter_urls(pages, partial, max_rules=0).where("page_id = 0").first()["verdict"] == "block"
    odd = spark.createDataFrame([(0, "http://10.2.3.4/x"), (1, "http://a-b-c-d-e.org/"), (2, "http://ok-site.org/"), (3, "http://x1y2z3a4b5c6.org"), (4, "http://best-casino.org/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(odd, rules).orderBy("page_id").collect()] == ["block", "block", "allow", "block", "block"]


def test_urls_by_trie_and_by_join_agree(spark, sf_dir):
    rng = random.Random(11)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    cut = pages.select(url_filter.host_of(pages["url"]).alias("h"), url_filter.path_of(pages["url"]).alias("p")).collect()
    rows = []
    for r in cut:
        labels, k = r["h"].split("."), rng.randrange(3)
        rows.append((".".join(labels[min(k, len(labels) - 1) :]), r["p"][: rng.randrange(len(r["p"]) + 1)], rng.choice(["allow", "block"])))
    rules = spark.createDataFrame(rows, "host string, path string, verdict string")
    one, two = (sorted(map(tuple, url_filter.filter_urls(pages, rules, max_rules=m).collect())) for m in (10_000, 0))
    assert one == two and any(r[3] for r in one)


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = queries.op7_quality_classifier(spark, d).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    rows = [(truth[r["doc_id"]], r["predicted"]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    good, bad = [p for q, p in rows if q], [p for q, p in rows if not q]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    score, trans, begin = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), 0.3
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    got, pairs, _ = quality_crf.marginals(score, mask, trans, begin)
    want, joint = np.zeros((3, 5)), np.zeros((2, 2))
    for i in range(3):
        n, total, one, two = mask[i].sum(), 0.0, np.zeros(5), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            w = np.exp(begin * y[0] + sum(score[i, t] * y[t] for t in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            one[:n] += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        want[i] += one / total
        joint += two / total
    assert np.allclose(got[mask], want[mask]) and np.allclose(pairs, joint)


def test_quality_without_labels_of_both_classes(spark, docs):
    few = docs.limit(20).unionByName(spark.createDataFrame([(900_000, "", "en", "s", 0), (900_001, None, "en", "s", 0)], docs.schema))
    ids = [r["doc_id"] for r in few.collect()]
    for labels, share in (([], quality_crf.BASE_RATE), ([(i, 1, 0) for i in ids], 1.0), ([(i, 0, 0) for i in ids], 0.0)):
        model = quality_crf.train(few, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scores = {r["doc_id"]: r["score"] for r in quality_crf.score_documents(few, model).collect()}
        assert all(s == (share if i < 900_000 else 0.0) for i, s in scores.items()) and quality_crf.keep_good(few, model).count() == len(ids)
    model = quality_crf.train(few.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality_crf.score_documents(few.limit(0), model).count() == 0


def test_quality_of_odd_texts(spark):
    good = [f"This is a plain line of words number {k}, and it goes on.\nAnother line follows it." for k in range(30)]
    bad = [f"buy### now$$$ %%% &&& {k} ***\n### ### ###" for k in range(30)]
    model = quality_crf.fit([*good, *bad], [1] * 30 + [0] * 30)
    df = frame(spark, ODD + good[:1] + bad[:1])
    s = {r["doc_id"]: r["score"] for r in quality_crf.score_documents(df, model).where("doc_id is not null").collect()}
    assert s[0] == s[1] == 0.0 and s[len(ODD)] > 0.7 > s[len(ODD) + 1]
    assert {r["doc_id"] for r in quality_crf.keep_good(df, model).collect() if r["doc_id"] is not None} == {i for i, x in s.items() if x >= 0.7}


def test_secrets_on_planted_findings(spark):
    """Forest trained without some kinds of strings, tried on them and on other hosts: precision before and after it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unseen = {"hex_secret", "base64_bearer", "git_token", "order", "uuid", "link"}
    known = secrets.planted_findings(docs.where("doc_id % 4 <> 2"), [k for k in secrets.KINDS if k[0] not in unseen], 100).cache()
    other = secrets.planted_findings(docs.where("doc_id % 4 = 2"), hosts=60, seed=99).cache()
    words = secrets.corpus_dictionary(docs, known.select("candidate").unionAll(other.select("candidate"))).cache()
    model = secrets.train(secrets.with_features(known, words))
    judged = secrets.judge(secrets.with_features(other.withColumnRenamed("is_secret", "truth"), words), model).collect()
    assert {k for k, _, _ in secrets.KINDS} - {r["planted"] for r in judged} <= {"public_key"}
    before = np.mean([r["truth"] for r in judged])
    after = np.mean([r["truth"] for r in judged if r["is_secret"]])
    found = np.mean([r["is_secret"] for r in judged if r["truth"]])
    assert before < 0.5 and after > 0.9 and found > 0.95
    seen = [r for r in judged if r["planted"] not in unseen]
    assert np.mean([r["is_secret"] == bool(r["truth"]) for r in seen]) > 0.98


def brute_findings(text):
    """(word_no, place, kind, candidate) by plain Python."""
    ws = re.split(r"[\x20\x09-\x0D]+", text)
    ask = "|".join(secrets.ASKING)
    assigns = rf"(?i:{ask})[\"'`]?\s*[:=]+>?\s*[\"'`]?"
    out = []
    for i, w in enumerate(ws):
        b, b2 = (ws[i - 1] if i else None), (ws[i - 2] if i > 1 else None)
        key = re.match(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", " ".join(ws[i : i + 4]))
        if key:
            out.append((i, 0, "block", key[0]))
            continue
        found = [("run", c) for c in re.findall(r"[A-Za-z0-9_+/\-]{12,}={0,2}", w) if re.search("[0-9]", c) or re.fullmatch(r"[A-Za-z_+/\-]{20,}=*", c)]
        m = re.search(assigns + r"([^\"'`]{8,})", w)
        value = None
        if m:
            value = m[1]
        elif b is not None and b.endswith(("=", ":", "=>")) and (re.search(assigns + "$", b) or (b in ("=", ":", "=>", ":=") and b2 is not None and re.search(rf"({ask})[\"'`]?$", b2.lower()))):
            value = re.sub("^[\"'`]", "", w) if len(w) >= 8 else None
        value = value and re.sub("[\"'`].*$|[,;]+$", "", value)
        if value and len(value) >= 8 and value not in [c for _, c in found]:
            found.append(("assigned", value))
        out += [(i, k, *f) for k, f in enumerate(found)]
    return out


def test_secret_candidates_against_brute_force(spark, docs):
    rng = random.Random(9)
    parts = ["password=", "Tr0ub4dor&3", "token", "=", ":", "\"2bc4a1ffe0d94b7c\"", "KEY", "apikey:", "'abcdefgh'", "x;", "aGVsbG8gd29ybGQhIQ==", "-----BEGIN", "RSA", "PRIVATE", "KEY-----", "PUBLIC", "a=AAAA1111BBBB;b=AAAA1111BBBB", "hunter2hunter2,", "qwertyuiopasdfghjklzxcvb", "secret:short", "=>", "pwd"]
    texts = [" ".join(rng.choice(parts) for _ in range(14)) for _ in range(120)] + ["", None, "password=\"Tr0ub4dor&3\" x", "-----BEGIN RSA PRIVATE KEY-----\nMIIE"]
    df = frame(spark, texts + [r["text"] for r in docs.limit(60).collect()])
    got = sorted(((r["doc_id"], r["word_no"], r["place"], r["kind"], r["candidate"]) for r in secrets.candidates(df).collect()), key=repr)
    want = sorted(((i, *f) for i, t in texts_of(df) for f in brute_findings(t)), key=repr)
    assert got == want and {r[3] for r in got} == {"run", "assigned", "block"}


def test_secret_features(spark):
    found = secrets.candidates(spark.createDataFrame([(1, 'the token = "RiverStone42x" ok', "app.env"), (2, "call 4432507379035540 now", None)], "doc_id long, text string, source string"))
    rows = {r["doc_id"]: r for r in secrets.with_features(found, spark.createDataFrame([("river",), ("stone",)], "word string")).collect()}
    assert (rows[1]["length"], round(rows[1]["covered"], 4), round(rows[1]["transitions"] * 13), rows[1]["quoted"], rows[1]["path_config"], rows[1]["asks_near"]) == (13.0, round(10 / 13, 4), 5, 1.0, 1.0, 1.0)
    assert (rows[2]["digits_only"], rows[2]["calms"], rows[2]["distinct"], rows[2]["covered"], rows[2]["path_config"]) == (1.0, 1.0, len(set("4432507379035540")) / 16, 0.0, 0.0)


def test_secret_verdict_does_not_depend_on_other_documents(spark):
    """One document with one order number: the forest knows both classes from what was planted."""
    one = spark.createDataFrame([(1, "your order 4432507379035540 was sent to you yesterday by our shop", "x")], "doc_id long, text string, source string")
    assert [r["is_secret"] for r in secrets.scan_secrets(one).collect()] == [False]
    assert secrets.scan_secrets(one.limit(0)).count() == 0
    table = spark.createDataFrame([(1, "x", 0, 0, "run", f"{k:016d}", "", "", "order", None, None, 0.0) for k in range(9)], "doc_id long, path string, word_no int, place int, kind string, candidate string, head string, tail string, before string, before2 string, after string, is_secret double")
    assert [r["score"] for r in secrets.scan_secrets(one, labelled=table).collect()] == [0.5]  # one class alone teaches nothing


def test_secret_forest_in_a_session_that_observes(spark):
    """The judged findings go to tasks after the session has used an observation, as streams and other queries do."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("rows")
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    one = spark.createDataFrame([(1, "password=hunter2!x9&kQ in the settings of our shop", "app.env")], "doc_id long, text string, source string")
    assert [r["is_secret"] for r in secrets.scan_secrets(one).collect()] == [True]


def test_token_store_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    df = frame(spark, ["O'Neill's don't", "***naïve*** (ÉTÉ)", *ODD, *[r["text"] for r in docs.limit(40).collect()]])
    t = Tokenizer.from_file(path)
    rows = sorted(((i, t.encode(x, add_special_tokens=False).ids + [1]) for i, x in texts_of(df)), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, ids in rows:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_store.store_and_read(df, path).orderBy("start").collect()]
    assert got == want
    assert token_store.store_and_read(df.limit(0), path).count() == 0


def test_ids_over_16_bits(spark, tmp_path):
    """A tokenizer with ids up to 70,000: nothing is cut."""
    import json

    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({**spec["added_tokens"][-1], "id": 70_000, "content": "zebrazebra", "special": False})
    spec["model"]["vocab"]["zebrazebra"] = 70_000
    path = str(tmp_path / "wide.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert token_store.width_of(token_store.vocabulary_of(path)) == "<u4" and token_store.width_of(1 << 16) == "<u2"
    from tokenizers import Tokenizer

    text = "a zebrazebra b"
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1]
    assert max(ids) == 70_000
    row = token_store.store_and_read(spark.createDataFrame([(5, text)], "doc_id long, text string"), path).first()
    assert tuple(row) == (5, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_each_distinct_word_is_looked_up_once(monkeypatch):
    """Whatever the caches hold and wherever a step ends, the ids are the library's."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counted(dict):
        seen = 0

        def get(self, *a):
            Counted.seen += 1
            return super().get(*a)

    path = queries.vocabulary("word_bpe_49k.json")
    words = ["Été,", "ÉTÉ", "(été)", "e\u0301te\u0301", "İx", "ſ", "Straße.", "don't", "'ll", "<|ENDOFTEXT|>", "<|endoftext|>", "x<|startoftext|>y", "a\tb\r", "\u00a0", "\x00", "***", "a-b", "_a_", "7up", "日本語", "ª", "µ", "×", "", "..foo..", "foo", "FOO"]
    texts = ["", " ", "\n\n", " ".join(words), "\n".join(reversed(words)), "foo", *words]
    t = Tokenizer.from_file(path)
    for cached, pieces, step in ((800_000, 700_000, 1 << 20), (3, 2, 1), (0, 0, 7)):
        monkeypatch.setattr(token_store, "WORDS", cached)
        monkeypatch.setattr(token_store, "PIECES", pieces)
        monkeypatch.setattr(token_store, "STEP", step)
        c = token_store.WordCoder(path)
        for width in ("<u2", "<u4", "<u2"):
            got = c.encode(pa.array(texts), 1, width).to_pylist()
            assert got == [np.array(t.encode(x, add_special_tokens=False).ids + [1], width).tobytes() for x in texts]
    c = token_store.WordCoder(path)
    c.words = Counted(c.words)
    assert len(c.encode(pa.array(["one two two\n" * 1000] * 5), 1, "<u2")) == 5
    assert Counted.seen == 3  # one, two and the empty word
    assert len(c.encode(pa.array([], pa.string()), 1, "<u2")) == 0


def test_byte_aligned_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_store.pack(v)
        assert (token_store.unpack(control, data, n) == v).all() and len(control) == -(-n // 4)


def brute_groups(rows):
    prints = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, f"{prints[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("limit", [200_000, 3])
def test_simhash_against_all_pairs(spark, docs, limit):
    rng = random.Random(4)
    texts = [r["text"] for r in docs.limit(60).collect()]
    for _ in range(60):
        ws = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 2])):
            ws[rng.randrange(len(ws))] = "edit"
        texts.append(" ".join(ws))
    df = frame(spark, [x for x in ODD if x is not None and len(x) < 5000] + texts).where("doc_id is not null")
    got = sorted(tuple(r) for r in simhash.group_documents(df, limit=limit).collect())
    assert got == brute_groups(texts_of(df))


def test_simhash_walk_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    v = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(8)] + [base]))
    got = {(int(min(a, b)), int(max(a, b))) for i, j in simhash.walk(v, np.array([0]), np.array([len(v)]), 2, 64) for a, b in zip(i, j, strict=True)}
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_near_copies_stage(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    texts, groups = [], []
    for g in range(40):
        ws = [rng.choice(words) for _ in range(rng.choice([60, 200, 400]))]
        texts.append(" ".join(ws))
        groups.append(g)
        for _ in range(3):
            copy = list(ws)
            for k in rng.sample(range(len(copy)), max(1, len(copy) // 100)):
                copy[k] = "edited"
            texts.append(" ".join(copy))
            groups.append(g)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, "", "", None])], "doc_id long, text string, component_id string")
    kept = [r["doc_id"] for r in simhash.drop_near_copies(df).collect()]
    assert {groups[i] for i in kept if i < len(groups)} == set(range(40))
    assert sum(i < len(groups) for i in kept) <= 42 and {len(texts), len(texts) + 1, len(texts) + 2} <= set(kept)


def test_slices_by_bytes():
    import pyarrow as pa

    from corpusloom.llm.common import SLICE, SLICE_BYTES, slices

    texts = ["a" * 10] * 600 + ["b" * (3 * SLICE_BYTES), None, "c" * (SLICE_BYTES // 2), "d" * (SLICE_BYTES // 2 + 1), ""]
    parts = [p.column(1).to_pylist() for p in slices(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"]), 1)]
    assert sum(parts, []) == texts and all(len(p) <= SLICE for p in parts)
    assert all(sum(len(t or "") for t in p) <= SLICE_BYTES or len(p) == 1 for p in parts)


def test_scratch_tables_are_deleted(spark):
    import os

    from corpusloom.llm.common import scratch, stored

    with scratch(spark):
        df = stored(spark.range(3), "some")
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 3 and os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_near_plan_scales_with_the_rows():
    """Chance meetings a row stay bounded and recall at 0.8 stays over 0.99, from a hundred rows to ten billion."""
    from math import comb

    for n in (0, 100, 40_000, 15_000_000, 10**10):
        words, tables, budget, _ = simhash.near_plan(n)
        width = tables[0][2]
        met = sum(comb(width, i) * simhash.DIFFER**i * (1 - simhash.DIFFER) ** (width - i) for i in range(budget + 1))
        assert n * sum(comb(width, i) for i in range(budget + 1)) / 2**width <= simhash.CHANCE and 1 - (1 - met) ** len(tables) > 0.99
        assert all(w < words and s + b <= 64 for w, s, b in tables)


@pytest.mark.parametrize("limit", [200_000, 40])
def test_recall_of_near_copies_by_edit_rate(spark, limit):
    """Pairs of texts with more and more edited words: all at 0.8 or more are found, none below (also when keys are dealt again)."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(9000)]
    texts, rate_of = [], []
    for g in range(240):
        ws = [rng.choice(words) for _ in range(rng.choice([30, 80, 200, 500]))]
        rate = (g % 12) * 0.004
        copy = [rng.choice(words) if rng.random() < rate else w for w in ws]
        texts += [" ".join(ws), " ".join(copy)]
        rate_of.append(rate)
    sets = [set(simhash.shingle_hashes(t, 5, 42).tolist()) for t in texts]
    near = {2 * g + 1 for g in range(240) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.near_copies(df, limit=limit).collect()}
    assert got <= near and len(got) >= 0.99 * len(near) and 100 < len(near) < 230


def test_keys_over_the_limit_meet_in_pairs_of_salts(spark):
    rows = spark.range(300).selectExpr("id", "id AS f0", "0 AS t", "CASE WHEN id < 250 THEN 7L ELSE id END AS key")
    keyed = simhash.salted(rows.select("id", "f0", "t", "key"), 40).collect()
    groups = {}
    for r in keyed:
        groups.setdefault(r["key"], set()).add(r["id"])
    assert max(map(len, groups.values())) < 140
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == {(a, b) for a in range(250) for b in range(a + 1, 250)}


def test_empty_tables(spark, docs):
    empty = frame(spark, [])
    assert licenses.scan_licenses(empty).count() == 0 and quality_rules.ledger(empty).count() == 0
    assert bpe.round_trip(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    assert simhash.group_documents(empty).count() == 0 and secrets.candidates(empty).count() == 0
    assert secrets.plant(empty).count() == 0 and quality_rules.ablations(quality_rules.ledger(empty), "v2").count() == 0
    assert simhash.drop_near_copies(empty).count() == 0 and line_dedup.drop_repeated_lines(empty).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out}
    assert kept and kept < {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not any(labels.get(i) == 0 for i in kept) and sum(labels.get(i) == 1 for i in kept) > 0.6 * sum(v == 1 for v in labels.values())


def test_pipeline_of_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    d = tmp_path / "odd"
    rows = [(1, "a line of words that is here\nthe same line", "x"), (2, "a line of words that is here\nthe same line", "y"), (None, "another text without an id", "z"), (3, None, "x"), (4, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, id string").write.parquet(str(d / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(d / f"{name}.parquet"))
    assert sorted((r["doc_id"] or 0 for r in corpus_pipeline.run(spark, str(d)).collect())) == [0, 1, 3, 4]


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage on what its predecessor kept, next to a plain one: lines, groups by all pairs, passages by all substrings."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    two = corpus_pipeline.lines(spark, one, sf_dir).cache()
    gone = {(i, k) for i, k, *_ in brute_lines([(r["doc_id"], r["text"] or "") for r in one.collect()])}
    want = {}
    for r in one.collect():
        ls = r["text"].split("\n")
        left = [x for k, x in enumerate(ls) if (r["doc_id"], k) not in gone]
        if len(left) == len(ls) or re.search(r"[^\x20\x09-\x0D]", "\n".join(left)):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want
    three = corpus_pipeline.near_copies(spark, two, sf_dir).cache()
    ids = sorted(i for i in want if want[i].split())
    sets = {i: set(simhash.shingle_hashes(want[i], 5, 42).tolist()) for i in ids}
    root = {i: i for i in want}
    for _ in range(5):
        for i in ids:
            for j in ids:
                if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r["doc_id"] for r in three.collect()} == {i for i in want if root[i] == i}
    four = {r["doc_id"] for r in corpus_pipeline.benchmark(spark, three, sf_dir).collect()}
    items = [decontaminate.words_of(r["text"]) for r in benchmark.collect()]
    held = set()
    for r in three.collect():
        ws = decontaminate.words_of(r["text"])
        if any((m := decontaminate.myers(p, ws, decontaminate.budget(len(p)))) for p in items if len(p) >= decontaminate.MIN_WORDS):
            held.add(r["doc_id"])
    assert four == {r["doc_id"] for r in three.collect()} - held


def test_matcher_against_all_substrings():
    rng = random.Random(8)
    for _ in range(60):
        items = [(n, " ".join(rng.choice("abcd") * 2 for _ in range(rng.choice([1, 3, 7, 8, 14, 20])))) for n in range(4)]
        text = []
        for _ in range(rng.randrange(0, 4)):
            ws = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(["x", "aa", "y"])
            text += ws + ["zz"] * rng.randrange(0, 3)
        found = {k: min(d for _, d, _ in v) for k, v in decontaminate.Matcher(items, 0.15).find(" ".join(text)).items()}
        want = {}
        for n, t in items:
            p = t.split()
            row = [0] * (len(text) + 1)  # an occurrence may start anywhere
            for i, x in enumerate(p, 1):
                prev, row = row, [i]
                for j, y in enumerate(text, 1):
                    row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            best = min(row[1:], default=99)
            if best <= decontaminate.budget(len(p)):
                want[n] = best
        assert found == want


def test_trie_links_with_shared_leaves(spark):
    """Two words a row; the 21-bit tables of the first hold many rows that share a leaf without being near."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        a, b = int(rng.integers(0, 8)) * 1_000_003, int(rng.integers(0, 2**62))
        for _ in range(5):
            flips = [1 << int(k) for k in rng.integers(0, 62, 3)]
            rows.append((len(rows), a, b ^ flips[0] ^ flips[1] ^ flips[2], g))
    df = spark.createDataFrame([r[:3] for r in rows], "id long, f0 long, f1 long")
    links = simhash.trie_links(df, [(0, s, 21) for s in (0, 21, 42)], 2, 8)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    low = {}
    for i, _, _, g in rows:
        low.setdefault(g, i)
    assert all(root.get(i, i) == low[g] for i, _, _, g in rows)


def test_near_copies_are_verified(spark):
    """Groups of copies with more and more edits, one large, and texts of one line repeated, against all pairs of shingle sets."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for g in range(40):
        ws = [rng.choice(words) for _ in range(rng.choice([60, 120, 300]))]
        for _ in range(150 if g == 0 else 6):
            copy = list(ws)
            for k in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0, 0.045)))):
                copy[k] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["one two three four five " * 40 + " ".join(rng.choice(words) for _ in range(n)) for n in (12, 12, 12)]
    sets = [set(simhash.shingle_hashes(t, 5, 42).tolist()) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        low = list(root)
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
        if low == root:
            break
        root = low
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert 50 < len(near) and got == {i: r for i, r in enumerate(root) if i != r}


def test_large_leaf_links_members_that_are_no_heads(spark):
    """1-2 and 3-4 are near by their heads 1 and 3; only 2 and 4 connect them. The order of the rows does not matter."""
    rows = [(1, 7, 0), (2, 7, (1 << 8) - 1), (3, 7, (1 << 24) - 1), (4, 7, (1 << 16) - 1), (5, 7, (1 << 25) - 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id long, f0 long, f1 long")
        links = simhash.trie_links(df, [(0, 0, 21)], 2, 8)
        assert {r["node"]: r["root"] for r in simhash.components(links).collect()} == dict.fromkeys(range(1, 6), 1)


def test_short_lines_repeat_too(spark):
    """Exact repeats from one word, near ones from five words."""
    texts = ["Les.\none two three\na b c d e", "Les.\none two four\na b x d e", "one  two three\na b c d\n\na b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.repeated_lines(df).collect()))
    assert got == [(1, 0, "exact", 0, 0), (1, 2, "near", 0, 2), (2, 0, "exact", 0, 1), (2, 3, "near", 0, 2)]
