"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from .quality import BOTH_MOST, CHAR_LEAST_CHARS, CHAR_MOST, COMMON, DOCS_LEAST, SYMBOLS, WORD_LEAST_WORDS, WORD_MOST, WORDS_LEAST
from .secrets import BASE, INNER, MORE, OWNERS

WORD = r"[^\x20\x09-\x0D]+"


def quality() -> str:
    classes = [r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"[.,;:!?''\"()’«»-]+", r"[0-9]+"]
    left, steps = "text", []
    for i, c in enumerate(classes):
        steps.append(f"regexp_replace({left}, '{c}', '', 'g') AS l{i}")
        left = f"l{i}"
    chain = "t0 AS (SELECT *, length(text) AS n_chars FROM documents)"
    for i, s in enumerate(steps):
        chain += f",\nt{i + 1} AS (SELECT *, {s} FROM t{i})"
    lengths = ["n_chars", *(f"length(l{i})" for i in range(len(classes))), "0"]
    shares = ", ".join(f"({a} - {b})::DOUBLE / n_chars" for a, b in zip(lengths, lengths[1:]))
    part = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    sums = ", ".join(f"(sum({x}) - sum({y}))::DOUBLE / sum(n_chars)" for x, y in zip(lengths, [*lengths[1:-1], "n_chars * 0"]))
    return f"""
WITH {chain},
w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k + 1:k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS k FROM w)),
again AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
fit AS (SELECT t.*, len(w.w) AS n_words FROM t{len(classes)} t JOIN w USING (doc_id) WHERE t.doc_id IN (SELECT doc_id FROM good) AND n_chars >= {CHAR_LEAST_CHARS} AND lang IS NOT NULL),
enough AS (SELECT lang, sum(n_words) AS n_words, [{sums}] AS shares FROM fit GROUP BY lang HAVING count(*) >= {DOCS_LEAST} AND sum(n_words) >= {WORDS_LEAST}),
rc AS (SELECT lang, CASE WHEN i = {len(classes)} THEN 1 - list_reduce(shares[1:{len(classes)}], lambda a, x: a + x) ELSE shares[i + 1] END AS q, i FROM enough, (SELECT unnest(range({len(classes) + 1})) AS i)),
share AS (SELECT doc_id, lang, unnest([{shares}]) AS p, unnest(range(6)) AS i FROM t{len(classes)} WHERE n_chars >= {CHAR_LEAST_CHARS}),
cd AS (SELECT doc_id, sqrt(greatest(sum({part('p', '((p + q) / 2)')} + {part('q', '((p + q) / 2)')}) / 2, 0)) AS d FROM share JOIN rc USING (lang, i) GROUP BY doc_id),
often AS (SELECT lang, lower(x) AS w, count(*) AS c FROM (SELECT f.lang, unnest(w.w) AS x FROM fit f JOIN w USING (doc_id)) GROUP BY lang, lower(x)),
rw AS (SELECT lang, w, c::DOUBLE / e.n_words AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS k FROM often) JOIN enough e USING (lang) WHERE k <= {COMMON}),
tok AS (SELECT doc_id, lower(x) AS w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w WHERE len(w) >= {WORD_LEAST_WORDS}) GROUP BY doc_id, lower(x)),
hist AS (SELECT d.doc_id, coalesce(t.c, 0)::DOUBLE / len(w.w) AS p, r.q FROM documents d JOIN w ON w.doc_id = d.doc_id AND len(w.w) >= {WORD_LEAST_WORDS} JOIN rw r ON r.lang = d.lang LEFT JOIN tok t ON t.doc_id = d.doc_id AND t.w = r.w),
whole AS (SELECT doc_id, p, q FROM hist UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM hist GROUP BY doc_id),
wd AS (SELECT doc_id, sqrt(greatest(sum({part('p', '((p + q) / 2)')} + {part('q', '((p + q) / 2)')}) / 2, 0)) AS d FROM whole GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, (length(d.text) - length(regexp_replace(d.text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, cd.d AS cd, wd.d AS wd
  FROM documents d JOIN w USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(cd, 0) <= {CHAR_MOST} AND coalesce(wd, 0) <= {WORD_MOST} AND coalesce(cd + wd, 0) <= {BOTH_MOST} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM base"""


MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k + 1:k + 5], ' ') FOR k IN range(len(w) - 4)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 70 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
classes AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id, CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY list_sort(s)) END AS class_size FROM sets),
links AS (SELECT p.a, count(DISTINCT y.class_id) AS n FROM pairs p JOIN classes x ON x.doc_id = p.a JOIN classes y ON y.doc_id = p.b WHERE x.class_id <> y.class_id GROUP BY p.a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id, s.doc_id <= coalesce(min(r.b), s.doc_id) AS kept, class_id, class_size, coalesce(any_value(l.n), 0) AS n_links
FROM classes s LEFT JOIN reach r ON r.a = s.doc_id LEFT JOIN links l ON l.a = s.doc_id GROUP BY s.doc_id, s.n, class_id, class_size"""

SUFFIX = """
WITH h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
grams AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS k FROM h)),
least AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS m FROM grams) WHERE m < doc_id),
starts AS (SELECT doc_id, k, max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 AS reach FROM least),
runs AS (SELECT doc_id, k, sum((reach IS NULL OR reach < k)::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM starts),
spans AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM runs GROUP BY doc_id, run),
sums AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans, list({'a': a, 'z': z} ORDER BY a) AS xs FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN xs IS NULL THEN h ELSE array_to_string([substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE xs[i].z END) + 1, 2 * ((CASE WHEN i = len(xs) THEN n ELSE xs[i + 1].a END) - (CASE WHEN i = 0 THEN 0 ELSE xs[i].z END))) FOR i IN range(len(xs) + 1)], '') END)) AS kept_sha256
FROM h LEFT JOIN sums USING (doc_id)"""


def secrets() -> str:
    every = {**BASE, **MORE}
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(every.items()):
        p = pattern.replace("'", "''")
        value = f"regexp_extract(vals[i], '{INNER[kind]}')" if kind in INNER else "vals[i]"
        size = f"length({value})" if kind in INNER else "length(hits[i])"
        found.append(f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, list_sum([length(x) FOR x IN pieces[1:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)::BIGINT AS a, {size} AS size, {value} AS value, {least} AS least
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, source, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS vals FROM documents WHERE regexp_matches(text, '{p}')))""")
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH every AS ({' UNION ALL '.join(found)}),
kept AS (SELECT *, kind || ':' || a || ':' || (a + size) AS span FROM every WHERE length(value) >= least),
spread AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n_repos, count(DISTINCT regexp_extract(coalesce(source, ''), '^[^/:]*')) AS n_owners FROM kept GROUP BY value),
docs AS (SELECT doc_id, {count}, string_agg(span, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans,
  count(*) FILTER (n_owners <= {OWNERS}) AS n_live, count(*) FILTER (n_owners > {OWNERS}) AS n_example, max(n_repos) AS most_repos, string_agg(CASE WHEN n_owners <= {OWNERS} THEN 'live' ELSE 'example' END, ',' ORDER BY a, rank) AS verdicts
  FROM kept JOIN spread USING (value) GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_repos, 0) AS most_repos, coalesce(verdicts, '') AS verdicts
FROM documents d LEFT JOIN docs USING (doc_id)"""
