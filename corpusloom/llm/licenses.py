"""License scan: a positional rare-token index over notice templates, in DataFrame functions only.

The index holds, for every template, its words with their positions and inverse document frequencies over the
templates. A file is tokenized once; its highest-IDF licence words are looked up in the postings, each posting
proposes a start (file position minus template position), the other postings of the template are intersected at that
relative position, and a start that keeps enough IDF mass must also hold the template's mandatory key phrase. All of
this happens inside one row: there is no shuffle, so a hot source or repeated rows cannot skew it, and the work is
linear in the words of the text. The index is a parameter of bounded size (``MAX_TEMPLATES``), which is why it is a literal:
the test whether a word is rare is a hash lookup, a rare word fetches its own postings from a map, and a posting its notice.

Null text: as an empty one (no words, no labels, score 0). Repeated rows each give their own result row, an empty table none.
Extra columns of the input are ignored. Places of the method may overlap; one place of a label counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of these characters after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base scan and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Common notices as (label, notice words, key phrase that must stand in its place).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions"),
    ("apache", "licensed under the apache license version 2 0", "apache license version"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied", "warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "affero general public license"),
    ("gfdl", "under the terms of the gnu free documentation license", "free documentation license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("artistic", "under the terms of the artistic license", "artistic license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by", "licensed under a creative commons attribution 3 0 unported license", "creative commons attribution 3"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "open font license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means", "may be reproduced"),
]

#: Share of a template's IDF mass that has to stand in place, and how many of its highest-IDF words propose starts.
MIN_MASS, ANCHORS = 0.75, 3
MAX_TEMPLATES = 500


def build_index(templates: list[tuple[str, str, str]] = TEMPLATES) -> list[dict]:
    """Per template: its words in order with IDF weights, the positions of its rarest words, and the key phrase's place."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    split = [(label, words_of(words), words_of(key)) for label, words, key in templates]
    df = Counter(w for _, words, _ in split for w in set(words))
    out = []
    for label, words, key in split:
        idf = [math.log(1 + len(split) / df[w]) for w in words]
        at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
        if at is None or not key:
            raise ValueError(f"the key phrase {' '.join(key)!r} is not in its template")
        rare = sorted(range(len(words)), key=lambda i: (-idf[i], i))[:ANCHORS]
        out.append({"label": label, "words": words, "idf": idf, "rare": rare, "key_at": at, "key": key})
    return out


def words_of(text: str) -> list[str]:
    """The words of a template as the scan takes them from a file."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(values: list) -> str:
    return "array(" + ", ".join(_quoted(v) if isinstance(v, str) else f"{v!r}D" for v in values) + ")"


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, min_mass: float = MIN_MASS) -> DataFrame:
    """doc_id, n_words, base hits (n_base, first_word, last_word, base_labels), labels, score and the matches themselves.

    ``matches`` lists every verified place as (label, start, mass); ``score`` is the largest mass, 1 at a base phrase.
    ``templates`` are (label, words, key phrase), cut into words as a file is (so "author's" is two); with none only the base
    phrases are found.
    """
    index = build_index(templates)
    notices = ", ".join(f"named_struct('label', {_quoted(t['label'])}, 'words', {_literal(t['words'])}, 'idf', {_literal(t['idf'])}, 'total', {sum(t['idf'])!r}D, 'key_at', {t['key_at']}, 'key', {_literal(t['key'])})" for t in index)
    of_word: dict[str, list[str]] = {}
    for k, t in enumerate(index):
        for i in t["rare"]:
            of_word.setdefault(t["words"][i], []).append(f"named_struct('notice', {k}, 'pos', {i})")
    postings = ", ".join(f"{_quoted(w)}, array({', '.join(ps)})" for w, ps in of_word.items())
    phrases = ", ".join(f"named_struct('words', {_literal(p.split())}, 'label', '{label}')" for p, label in BASE)
    rare = sorted({t["words"][i] for t in index for i in t["rare"]} | {p.split()[0] for p, _ in BASE})
    looked_up = ", ".join(f"'{w}'" for w in rare)
    # ws: the file's words; at: positions of its rare licence words; p: a posting of such a word; n: the posting's notice.
    kept = "filter(transform(ws, (w, i) -> CASE WHEN w IN (%s) THEN i END), i -> i IS NOT NULL)" % looked_up
    mass = "aggregate(transform(n.words, (x, k) -> CASE WHEN get(ws, i - p.pos + k) = x THEN n.idf[k] ELSE 0D END), 0D, (a, b) -> a + b) / n.total"
    proposed = (
        f"flatten(transform(coalesce(try_element_at(map({postings}), get(ws, i)), cast(array() AS array<struct<notice: int, pos: int>>)), p -> transform(filter(array(array({notices})[p.notice]), "
        f"n -> i >= p.pos AND slice(ws, i - p.pos + n.key_at + 1, size(n.key)) = n.key), n -> named_struct('label', n.label, 'start', i - p.pos, 'mass', {mass}))))"
    )
    if not index:
        proposed = "cast(array() AS array<struct<label: string, start: int, mass: double>>)"
    based = f"transform(filter(array({phrases}), b -> slice(ws, i + 1, size(b.words)) = b.words), b -> named_struct('label', b.label, 'start', i, 'mass', 1D))"
    scan = (
        "transform(array(regexp_extract_all(translate(coalesce(_text, ''), '" + UPPER + "', '" + LOWER + "'), _pattern, 0)), ws -> transform(array(" + kept + "), at -> named_struct("
        f"'n_words', cast(size(ws) AS bigint), 'base', flatten(transform(at, i -> {based})), "
        f"'hits', array_distinct(filter(flatten(transform(at, i -> {proposed})), h -> h.mass >= {min_mass}D))))[0])[0]"
    )
    got = docs.select("doc_id", F.col(text).alias("_text"), F.lit(WORD).alias("_pattern")).select("doc_id", F.expr(scan).alias("s"))
    starts, hits = F.transform("s.base", lambda h: h["start"].cast("long")), F.col("s.hits")
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda h: h["label"]))))
    return got.select(
        "doc_id",
        F.col("s.n_words").alias("n_words"),
        F.size("s.base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("s.base")).alias("base_labels"),
        labels(F.concat(F.col("s.base"), hits)).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform(F.concat(F.col("s.base"), hits), lambda h: h["mass"])), F.lit(0.0)), 6).alias("score"),
        F.concat(F.col("s.base"), hits).alias("matches"),
    )
