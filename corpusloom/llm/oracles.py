"""DuckDB SQL for the operators that SQL can express. Rules and bounds are written out here, not taken from the operators;
only the notices and the list of spam words are (they are data)."""

from __future__ import annotations

from corpusloom.llm.licenses import TEMPLATES
from corpusloom.llm.url_filter import SPAM_WORDS


def licence_sql() -> str:
    """Words as rows. Base places by three words in a row; notices by rare words, the key phrase in place, and IDF mass."""
    notices = ", ".join(f"({k}, '{label}', '{words}', '{key}')" for k, (label, words, key) in enumerate(TEMPLATES))
    return (
        f"WITH t(id, label, txt, key) AS (VALUES {notices}), tw AS (SELECT id, unnest(string_split(txt, ' ')) AS word, generate_subscripts(string_split(txt, ' '), 1) - 1 AS pos FROM t), "
        "df AS (SELECT word, count(DISTINCT id) AS df FROM tw GROUP BY word), ti AS (SELECT id, word, pos, ln(1 + (SELECT count(*) FROM t) / CAST(df AS DOUBLE)) AS idf FROM tw JOIN df USING (word)), "
        "rare AS (SELECT id, word, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idf DESC, pos) AS r FROM ti) WHERE r <= 3), total AS (SELECT id, sum(idf) AS total FROM ti GROUP BY id), "
        "kw AS (SELECT id, len(string_split(substr(txt, 1, instr(' ' || txt || ' ', ' ' || key || ' ') - 1), ' ')) - 1 + generate_subscripts(string_split(key, ' '), 1) - 1 AS pos FROM t), kn AS (SELECT id, count(*) AS n_key FROM kw GROUP BY id), "
        "d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents), "
        "w AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d), "
        "w3 AS (SELECT row, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY row ORDER BY i)), "
        "base AS (SELECT row, i, 'mit' AS label, 1.0::DOUBLE AS mass FROM w3 WHERE a = 'mit' AND b = 'license' UNION ALL SELECT row, i, 'apache', 1.0 FROM w3 WHERE a = 'apache' AND b = 'license' UNION ALL SELECT row, i, 'gpl', 1.0 FROM w3 WHERE a = 'general' AND b = 'public' AND c = 'license'), "
        "h AS (SELECT DISTINCT row, id, i - pos AS start FROM w JOIN rare USING (word) WHERE i >= pos), "
        "m AS (SELECT h.row, h.id, h.start, sum(idf) AS got, count(*) FILTER (kw.pos IS NOT NULL) AS keys FROM h JOIN ti ON ti.id = h.id JOIN w ON w.row = h.row AND w.i = h.start + ti.pos AND w.word = ti.word LEFT JOIN kw ON kw.id = h.id AND kw.pos = ti.pos GROUP BY ALL), "
        "hit AS (SELECT row, start AS i, label, got / total AS mass FROM m JOIN total USING (id) JOIN kn USING (id) JOIN t USING (id) WHERE keys = n_key AND got / total >= 0.75), "
        "b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row), "
        "a AS (SELECT row, max(mass) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT * FROM base UNION ALL SELECT * FROM hit) GROUP BY row) "
        "SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN b USING (row) LEFT JOIN a USING (row)"
    )


def rules_sql() -> str:
    tests = ["n_words < 50", "100 * n_repeat_words > 50 * n_words", "10 * n_symbols > 5 * n_words", "n_words >= 20 AND 2 * n_upper > word_chars", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_words >= 20 AND word_chars > 20 * n_words"]
    failed = " + ".join(f"CASE WHEN {test} THEN {2**k} ELSE 0 END" for k, test in enumerate(tests))
    return (
        f"WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), "
        "t AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w), "
        "g AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
        "n AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice FROM g), "
        "r AS (SELECT doc_id, count(*) FILTER (twice OR p1 OR p2) AS n_repeat_words FROM (SELECT doc_id, twice, coalesce(lag(twice, 1) OVER o, false) AS p1, coalesce(lag(twice, 2) OVER o, false) AS p2 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id), "
        f"l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id), "
        "m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)), "
        f"f AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m) SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept FROM f"
    )


def url_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    labels = "list_transform(string_split(host, '.'), lambda l: string_split(l, '-'))"
    digits = "len(regexp_replace(l, '[^0-9]', '', 'g'))"
    spam = "(^|[.-])(" + "|".join(SPAM_WORDS) + ")([.-]|$)"
    odd = (
        f"regexp_matches(host, '{spam}') OR regexp_full_match(host, '[0-9.]+') OR starts_with(host, '[') OR list_max(list_transform({labels}, lambda l: len(l))) > 4 "
        f"OR list_max(list_transform(string_split(host, '.'), lambda l: {digits})) >= 6 OR list_max(list_transform(string_split(host, '.'), lambda l: len(l))) >= 40"
    )
    return (
        "WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages), "
        f"r AS (SELECT *, CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {fits('example.com', '/de/')} THEN 'example.com/de/' WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END AS rule FROM p) "
        f"SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN {odd} THEN 'block' ELSE 'allow' END AS verdict FROM r"
    )


def lines_sql() -> str:
    """Distinct lines, their variants without one word, and the three ways in which one word edit shows."""
    return (
        f"WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_extract_all(s[i], '[^\\x20\\x09-\\x0D]+') AS ws FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)), "
        f"k AS (SELECT DISTINCT doc_id, line_no, ws FROM l WHERE len(ws) >= 1), "
        "d AS (SELECT ws, min(struct_pack(d := doc_id, n := line_no)) AS first, count(*) AS c FROM k GROUP BY ws), "
        f"v AS (SELECT first, ws, i, list_concat(ws[1 : i - 1], ws[i + 1 :]) AS rest FROM (SELECT first, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 5)), "
        "s AS (SELECT v.first, min(o.first) AS near FROM v JOIN v o ON v.rest = o.rest AND v.i = o.i AND o.first < v.first GROUP BY ALL), "
        f"w AS (SELECT DISTINCT v.first AS long, d.first AS short FROM v JOIN d ON v.rest = d.ws WHERE len(d.ws) >= 5), "
        "n AS (SELECT first, min(near) AS near FROM (SELECT first, near FROM s UNION ALL SELECT long, short FROM w WHERE short < long UNION ALL SELECT short, long FROM w WHERE long < short) GROUP BY first) "
        "SELECT doc_id, line_no, CASE WHEN d.first < struct_pack(d := doc_id, n := line_no) THEN 'exact' ELSE 'near' END AS kind, CASE WHEN d.first < struct_pack(d := doc_id, n := line_no) THEN d.first.d ELSE near.d END AS of_doc_id, CASE WHEN d.first < struct_pack(d := doc_id, n := line_no) THEN d.first.n ELSE near.n END AS of_line "
        "FROM k JOIN d USING (ws) LEFT JOIN n ON n.first = d.first WHERE d.first < struct_pack(d := doc_id, n := line_no) OR near IS NOT NULL"
    )


ORACLE_SQL = {"op1_license_scan": licence_sql(), "op2_quality_rules": rules_sql(), "op5_line_dedup": lines_sql(), "op6_url_filter": url_sql()}

ORACLE_SQL["op12_prefix_trie"] = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), whole AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY k) AS turns FROM t GROUP BY conv_id),
-- crc32 of the decimal id: a -1 stands for one of the eight shifts after each byte
crc AS (
    SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 6 AS h
    FROM whole
), built AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
    FROM crc c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 100
), member AS (SELECT conv_id, turns[1:d] AS seq, d, len(turns) AS n FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM built)),
node AS (
    SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
    FROM member GROUP BY seq, d
), linked AS (
    SELECT v.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
    FROM node v LEFT JOIN node p ON v.d > 0 AND p.seq = v.seq[1:v.d - 1]
    LEFT JOIN (SELECT seq[1:d - 1] AS seq, count(*) AS n FROM node WHERE d > 0 GROUP BY 1) c ON c.seq = v.seq
), below AS (
    SELECT seq[1:a] AS seq, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT seq, unnest(range(d + 1)) AS a, (n_children = 0)::BIGINT AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(seq[d].x) END AS saved FROM linked) GROUP BY 1
)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, l.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.seq = l.seq
"""
