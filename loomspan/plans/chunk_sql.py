"""SQL for DuckDB that does what the folds do: sentences packed, texts split level by level, groups packed again.

The texts are heads of WITH lists; each continues the one that it is given.
"""

from __future__ import annotations

EDGES = "('title', 'table', 'image', 'equation')"
MARK = "chr(57344) || chr(57345)"
#: Python's str.split() characters for RE2.
SP = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def count(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def split(x: str, pattern: str, keep: bool, least: int) -> str:
    """The stripped parts of a text of at least so many characters, or the stripped text."""
    marked = f"regexp_replace({x}, '({pattern})', '{chr(92) + '1' if keep else ''}' || {MARK}, 'g')"
    parts = f"list_filter([{strip('p')} for p in string_split({marked}, {MARK})], lambda p: length(p) >= {least})"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{strip(x)}] END"


def place(block: str) -> str:
    """A block's page and box as text; fixtures' boxes follow from the block's number."""
    return f"({block} // 20) || ',50,' || (({block} % 20) * 50) || ',950,' || (({block} % 20) * 50 + 45)"


def numbered(head: str, every: str, granularity: str = "''", tokens: str = "0") -> str:
    """``every``: (source, o, kind, page_content, title_path, title_level, blocks) in the order of o."""
    return f"""{head},
rows AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {every})
SELECT source, i::INTEGER AS chunk_index, kind, page_content, title_path, title_level, reading_order, CASE WHEN i > 0 THEN i - 1 END::INTEGER AS prev_chunk_index, CASE WHEN i < n - 1 THEN i + 1 END::INTEGER AS next_chunk_index,
  {granularity} AS granularity, ({tokens})::INTEGER AS token_count, array_to_string(blocks, ',') AS block_list, array_to_string([{place('b')} for b in blocks], ';') AS position_list, NULL::INTEGER AS parent_index FROM rows"""


def runs(titles: str, content: str) -> str:
    """edges: titles and standalone blocks, alone: standalone ones as chunks, kept: blocks with their run."""
    return f"""{titles},
kept AS (SELECT *, kind IN {EDGES} AS edge, sum((kind IN {EDGES})::INTEGER) OVER (PARTITION BY source ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS run FROM titled WHERE kind <> 'discarded'),
edges AS (SELECT source, run, block_index, kind, title_path, title_level, {content} AS content FROM kept WHERE edge),
alone AS (SELECT source, [run, 0] AS o, kind, content AS page_content, title_path, title_level, block_index AS reading_order, [block_index] AS blocks FROM edges)"""


GLUE = "CASE WHEN right(o, 1) NOT IN (' ', chr(10), chr(9), '(', '[', '{', '/', '-') AND left(s, 1) NOT IN (' ', chr(10), chr(9), '.', ',', ';', ':', '!', '?', ')', ']', '}', '/', '-') THEN ' ' ELSE '' END"


def sentences(titles: str, content: str, size: int, overlap: int) -> str:
    """packed: the sentence chunker's chunks (without discarded blocks, at least one sentence a chunk)."""
    ids = lambda b: f"{{'ids': [x.i for x in {b}], 'solo': false}}"
    tail = f"list_filter(a.buf, lambda b, k: list_sum([c.n for c in a.buf[k:]]) <= {overlap})"
    rest = f"coalesce(list_sum([b.n for b in {tail}]), 0)"
    limit = f"greatest(10, {size} - a.pre)"
    emitted = f"CASE WHEN len(a.buf) > 0 THEN list_append(a.done, {ids('a.buf')}) ELSE a.done END"
    both = lambda when: f"CASE WHEN len(a.buf) > 0 AND len({tail}) > 0 AND {when} THEN list_append({emitted}, {ids(tail)}) ELSE {emitted} END"
    none = "[]::STRUCT(i BIGINT, n BIGINT)[]"
    step = f"""CASE WHEN x.n > {limit} THEN {{'done': list_append({both('true')}, {{'ids': [x.i], 'solo': true}}), 'buf': {none}, 'total': 0::BIGINT, 'pre': 0::BIGINT}}
      WHEN a.total + x.n > {limit} THEN {{'done': {both(f'{rest} + x.n > {size}')}, 'buf': CASE WHEN {rest} + x.n > {size} THEN [x] ELSE list_append({tail}, x) END, 'total': (CASE WHEN {rest} + x.n > {size} THEN 0 ELSE {rest} END + x.n)::BIGINT, 'pre': 0::BIGINT}}
      ELSE {{'done': a.done, 'buf': list_append(a.buf, x), 'total': a.total + x.n, 'pre': a.pre}} END"""
    start = f"{{'done': []::STRUCT(ids BIGINT[], solo BOOLEAN)[], 'buf': {none}, 'total': 0::BIGINT, 'pre': pre}}"
    return f"""{runs(titles, content)},
body AS (SELECT source, run, block_index, kind, {strip('text')} AS t FROM kept WHERE NOT edge AND {strip('text')} <> ''),
placed AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY source, run ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM body),
merged AS (SELECT source, run, string_agg(t, chr(10) ORDER BY block_index) AS m FROM body GROUP BY source, run),
cut AS (SELECT source, run, m, {split('m', '[.] |! |[?] |' + chr(92) + 'n', True, 12)} AS parts FROM merged),
located AS (SELECT source, run, list_reduce(parts, lambda f, p: {{'out': list_append(f.out, {{'s': p, 'a': CASE WHEN instr(substr(m, f.at + 1), p) > 0 THEN f.at + instr(substr(m, f.at + 1), p) - 1 WHEN instr(m, p) > 0 THEN instr(m, p) - 1 ELSE f.at END}}),
    'at': CASE WHEN instr(substr(m, f.at + 1), p) > 0 THEN f.at + instr(substr(m, f.at + 1), p) - 1 WHEN instr(m, p) > 0 THEN instr(m, p) - 1 ELSE f.at END + length(p)}},
  {{'out': []::STRUCT(s VARCHAR, a BIGINT)[], 'at': 0::BIGINT}}).out AS xs FROM cut),
sent AS (SELECT source, run, k AS i, x.s AS s, x.a AS a, x.a + length(x.s) AS z, {count('x.s')} AS n FROM (SELECT source, run, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM located)),
of AS (SELECT s.source, s.run, s.i, list(p.block_index ORDER BY p.block_index) AS blocks, arg_min(p.kind, p.block_index) AS kind FROM sent s JOIN placed p ON s.source = p.source AND s.run = p.run AND p.lo + length(p.t) > s.a AND p.lo < s.z GROUP BY s.source, s.run, s.i),
listed AS (SELECT s.source, s.run, list(s.s ORDER BY s.i) AS texts, list({{'i': s.i, 'n': s.n}} ORDER BY s.i) AS xs, list(o.blocks ORDER BY s.i) AS blocks, list(o.kind ORDER BY s.i) AS kinds FROM sent s JOIN of o USING (source, run, i) GROUP BY s.source, s.run),
headed AS (SELECT l.*, CASE WHEN e.kind = 'title' THEN e.title_path ELSE '' END AS prefix, CASE WHEN e.kind = 'title' AND e.title_path <> '' THEN {count("e.title_path || chr(10) || chr(10)")} ELSE 0 END::BIGINT AS pre, coalesce(e.title_path, '') AS title_path, coalesce(e.title_level, 0) AS title_level
  FROM listed l LEFT JOIN edges e USING (source, run)),
folded AS (SELECT *, list_reduce(xs, lambda a, x: {step}, {start}) AS st FROM headed),
ended AS (SELECT *, CASE WHEN len(st.buf) > 0 THEN list_append(st.done, {ids('st.buf')}) ELSE st.done END AS done FROM folded),
each AS (SELECT *, unnest(done) AS c, unnest(range(len(done))) AS k FROM ended),
packed AS (SELECT source, [run, k + 1] AS o, CASE WHEN c.solo THEN kinds[c.ids[1] + 1] ELSE 'text' END AS kind,
    CASE WHEN k = 0 AND prefix <> '' THEN prefix || chr(10) || chr(10) ELSE '' END || list_reduce([texts[j + 1] for j in c.ids], lambda o, s: o || {GLUE} || s) AS page_content,
    title_path, title_level, blocks[c.ids[1] + 1][1] AS reading_order, list_sort(list_distinct(flatten([blocks[j + 1] for j in c.ids]))) AS blocks FROM each
  UNION ALL SELECT source, o, kind, page_content, title_path, title_level, reading_order, blocks FROM alone WHERE kind <> 'title'
  UNION ALL SELECT e.source, [e.run, 0], 'title', e.title_path, e.title_path, e.title_level, e.block_index, [e.block_index] FROM edges e ANTI JOIN listed l USING (source, run) WHERE e.kind = 'title')"""


#: Patterns of the levels, whether their delimiter stays with the part before, and the least length of a part.
LEVELS = [(r"\n\n\n|\n\n", False, 24), (r"[.] |! |[?] |[.]\n|!\n|[?]\n", True, 24), (", |; |: ", True, 24), None, None]


def pieces(x: str, level: int) -> str:
    if LEVELS[level] is None:
        return f"list_filter(regexp_split_to_array({x}, '{SP}+'), lambda p: p <> '')"
    return split(x, *LEVELS[level])


def recursive(titles: str, content: str, size: int) -> str:
    """joined: texts of runs; r0.out: their pieces of at most ``size`` tokens."""
    sql = f"""{runs(titles, content)},
body AS (SELECT source, run, block_index, text AS t, title_path, title_level FROM kept WHERE NOT edge AND {strip('text')} <> ''),
joined AS (SELECT source, run, string_agg(t, '' ORDER BY block_index) AS m, list(block_index ORDER BY block_index) AS blocks, list(length(t) ORDER BY block_index) AS sizes, any_value(title_path) AS title_path, any_value(title_level) AS title_level FROM body GROUP BY source, run),
d0 AS (SELECT source, run, [0]::BIGINT[] AS ad, m AS t FROM joined WHERE {count('m')} > {size})"""
    last = len(LEVELS) - 1
    for k in range(len(LEVELS)):
        # a text that the level doesn't part goes on whole, and what becomes of it isn't joined again here
        sql += f""",
p{k} AS (SELECT source, run, ad, t, {pieces('t', k)} AS parts FROM d{k}),
q{k} AS (SELECT *, parts = [{strip('t')}] AS whole FROM p{k}),
e{k} AS (SELECT source, run, ad, whole, unnest(CASE WHEN whole THEN [t] ELSE parts END) AS t, unnest(range(CASE WHEN whole THEN 1 ELSE len(parts) END)) AS j FROM q{k})"""
        if k < last:
            sql += f""",
d{k + 1} AS (SELECT source, run, list_append(ad, j) AS ad, t FROM e{k} WHERE {count('t')} > {size})"""
    for k in range(last, -1, -1):
        below = f"LEFT JOIN r{k + 1} r ON r.source = e.source AND r.run = e.run AND r.ad = list_append(e.ad, e.j)" if k < last else ""
        of = "coalesce(r.out, [e.t])" if k < last else "[e.t]"
        sql += f""",
f{k} AS (SELECT e.source, e.run, e.ad, e.whole, flatten(list({of} ORDER BY e.j)) AS xs FROM e{k} e {below} GROUP BY e.source, e.run, e.ad, e.whole),
r{k} AS (SELECT source, run, ad, CASE WHEN whole THEN xs ELSE {greedy('xs', size)} END AS out FROM f{k})"""
    return sql


def greedy(xs: str, size: int) -> str:
    """Neighbouring texts joined by blanks as far as ``size`` tokens, each counted alone, allow."""
    return f"""[array_to_string(g, ' ') for g in list_reduce({xs}, lambda a, p: CASE WHEN len(a.groups) > 0 AND a.total + {count('p')} <= {size} THEN {{'groups': list_append(a.groups[:-2], list_append(a.groups[-1], p)), 'total': a.total + {count('p')}}}
      ELSE {{'groups': list_append(a.groups, [p]), 'total': {count('p')}}} END, {{'groups': []::VARCHAR[][], 'total': 0::BIGINT}}).groups]"""


def located(pieces_of: str) -> str:
    """split: chunks of the pieces (source, run, k, p) of ``joined`` texts; a piece that isn't found has all blocks."""
    return f"""found AS (SELECT j.*, x.k, x.p, instr(j.m, x.p) - 1 AS a FROM {pieces_of} x JOIN joined j USING (source, run) WHERE {strip('x.p')} <> ''),
mine AS (SELECT *, CASE WHEN a < 0 THEN blocks ELSE [b for b, i in blocks if list_sum(sizes[:i]) > a AND list_sum(sizes[:i]) - sizes[i] < a + length(p)] END AS own FROM found),
split AS (SELECT source, [run, k + 1] AS o, 'text' AS kind, p AS page_content, title_path, title_level, own[1] AS reading_order, own AS blocks FROM mine UNION ALL SELECT * FROM alone)"""


def recursive_chunks(titles: str, content: str, size: int) -> str:
    head = f"""{recursive(titles, content, size)},
outs AS (SELECT j.source, j.run, coalesce(r.out, [j.m]) AS out FROM joined j LEFT JOIN r0 r USING (source, run)),
ps AS (SELECT source, run, unnest(out) AS p, unnest(range(len(out))) AS k FROM outs),
{located('ps')}"""
    return numbered(head, "split")


def guided_chunks(titles: str, content: str, size: int, candidate: int) -> str:
    """Candidate spans by the levels, unjoined; groups of ``size`` tokens end before their longest passage after the
    first, or at their end if there are fewer than three."""
    sql = f"""{runs(titles, content)},
body AS (SELECT source, run, block_index, text AS t, title_path, title_level FROM kept WHERE NOT edge AND {strip('text')} <> ''),
joined AS (SELECT source, run, string_agg(t, '' ORDER BY block_index) AS m, list(block_index ORDER BY block_index) AS blocks, list(length(t) ORDER BY block_index) AS sizes, any_value(title_path) AS title_path, any_value(title_level) AS title_level FROM body GROUP BY source, run),
d0 AS (SELECT source, run, [0]::BIGINT[] AS ad, m AS t FROM joined)"""
    for k in range(len(LEVELS)):
        sql += f""",
l{k} AS (SELECT * FROM d{k} WHERE {strip('t')} <> '' AND {count('t')} <= {candidate}),
s{k} AS (SELECT source, run, ad, {pieces('t', k)} AS parts FROM d{k} WHERE {strip('t')} <> '' AND {count('t')} > {candidate}),
d{k + 1} AS (SELECT source, run, list_append(ad, j) AS ad, t FROM (SELECT source, run, ad, unnest(parts) AS t, unnest(range(len(parts))) AS j FROM s{k}))"""
    n = len(LEVELS)
    leaves = " UNION ALL ".join(f"SELECT source, run, ad, {strip('t')} AS t FROM l{k}" for k in range(n)) + f" UNION ALL SELECT source, run, ad, {strip('t')} FROM d{n} WHERE {strip('t')} <> ''"
    ad = "instr(substr(m, f.ad + 1), p)"
    sql += f""",
leaves AS ({leaves}),
lists AS (SELECT l.source, l.run, any_value(j.m) AS m, list(l.t ORDER BY l.ad) AS parts FROM leaves l JOIN joined j USING (source, run) GROUP BY l.source, l.run),
spans AS (SELECT source, run, m, list_reduce(parts, lambda f, p: CASE WHEN {ad} > 0 THEN {{'out': list_append(f.out, {{'a': f.ad + {ad} - 1, 'z': f.ad + {ad} - 1 + length(p)}}), 'ad': f.ad + {ad} - 1 + length(p)}} ELSE f END, {{'out': []::STRUCT(a BIGINT, z BIGINT)[], 'ad': 0::BIGINT}}).out AS xs FROM lists),
sums AS (SELECT source, run, m, xs, [length('ID ' || (i - 1) || ': ') + x.z - x.a for x, i in xs] AS shown, list_prepend(0::BIGINT, [list_sum([{count('substr(m, y.a + 1, y.z - y.a)')} for y in xs[:i]])::BIGINT for x, i in xs]) AS sums FROM spans),
step AS (SELECT source, run, ad, greatest(ad + 1, least(len([v for v in sums if v < sums[ad + 1] + {size}]) - 1, len(xs))) AS stop FROM (SELECT *, unnest(range(len(xs))) AS ad FROM sums)),
choice AS (SELECT t.source, t.run, t.ad, CASE WHEN t.stop - t.ad < 3 THEN t.stop ELSE t.ad + list_position(shown[t.ad + 2:t.stop], list_max(shown[t.ad + 2:t.stop])) END AS cut FROM step t JOIN sums s USING (source, run)),
walk AS (SELECT source, run, 0::BIGINT AS k, ad, cut FROM choice WHERE ad = 0 UNION ALL SELECT w.source, w.run, w.k + 1, c.ad, c.cut FROM walk w JOIN choice c ON c.source = w.source AND c.run = w.run AND c.ad = w.cut),
ps AS (SELECT w.source, w.run, w.k, substr(s.m, s.xs[w.ad + 1].a + 1, s.xs[w.cut].z - s.xs[w.ad + 1].a) AS p FROM walk w JOIN sums s USING (source, run)),
{located('ps')}"""
    return numbered(sql, "split").replace("WITH ", "WITH RECURSIVE ", 1)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


def crc32(w: str) -> str:
    table = f"({_crc_table()}::BIGINT[])"
    return f"xor(list_reduce([('0x' || hex(encode({w}))[2 * k + 1:2 * k + 2])::BIGINT for k in range(octet_length(encode({w})))], lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def semantic_chunks(titles: str, content: str, percent: float, ahead: int = 0) -> str:
    """Sentences of single blocks, cut where the cosine of neighbours' hashed words is below the run's percentile.

    With ``ahead`` it is the greatest cosine with so many next ones, and neighbouring groups of similar centroids are
    joined, pair by pair from the left, until no pair is.

    Smoothing by polynomials of degree 2 over 3 values gives the values themselves."""
    head = f"""{runs(titles, content)},
cut AS (SELECT source, run, block_index, title_path, title_level, {split('text', '[.] |! |[?] |' + chr(92) + 'n', True, 12)} AS parts FROM kept WHERE NOT edge AND {strip('text')} <> ''),
raw AS (SELECT source, run, block_index, title_path, title_level, unnest(parts) AS s, unnest(range(len(parts))) AS j FROM cut),
sent AS (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY block_index, j) AS i FROM raw),
words AS (SELECT source, run, i, unnest(list_filter(regexp_split_to_array(lower(s), '{SP}+'), lambda w: w <> '')) AS w FROM sent),
hashed AS (SELECT w, {crc32('w')} AS h FROM (SELECT DISTINCT w FROM words)),
adds AS (SELECT source, run, i, h % 64 AS slot, 1 AS x FROM words JOIN hashed USING (w) UNION ALL SELECT source, run, i, (h >> 16) % 64, CASE WHEN h & 32768 > 0 THEN -1 ELSE 1 END FROM words JOIN hashed USING (w)),
vec AS (SELECT source, run, i, slot, sum(x)::DOUBLE AS x FROM adds GROUP BY source, run, i, slot),
norms AS (SELECT source, run, i, sqrt(sum(x * x)) AS n FROM vec GROUP BY source, run, i),
dots AS (SELECT a.source, a.run, a.i, b.i AS j, sum(a.x * b.x) AS d FROM vec a JOIN vec b ON a.source = b.source AND a.run = b.run AND b.i BETWEEN a.i + 1 AND a.i + {max(1, ahead)} AND a.slot = b.slot GROUP BY a.source, a.run, a.i, b.i),
sims AS (SELECT s.source, s.run, s.i, max(round(coalesce(d.d / nullif(m.n * o.n, 0), 0), 9)) AS sim FROM sent s JOIN sent t ON t.source = s.source AND t.run = s.run AND t.i BETWEEN s.i + 1 AND s.i + {max(1, ahead)} LEFT JOIN dots d ON d.source = s.source AND d.run = s.run AND d.i = s.i AND d.j = t.i
  LEFT JOIN norms m ON m.source = s.source AND m.run = s.run AND m.i = s.i LEFT JOIN norms o ON o.source = s.source AND o.run = s.run AND o.i = t.i GROUP BY s.source, s.run, s.i),
bounds AS (SELECT source, run, quantile_cont(sim, {percent / 100}) AS bound FROM sims GROUP BY source, run),
cuts AS (SELECT s.*, coalesce(sum((m.sim < b.bound)::INTEGER) OVER (PARTITION BY s.source, s.run ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM sent s LEFT JOIN sims m USING (source, run, i) LEFT JOIN bounds b USING (source, run)),
{merged_groups(1 - percent / 100) if ahead else "parted AS (SELECT * FROM cuts)"},
joined AS (SELECT source, [run, g + 1] AS o, 'text' AS kind, string_agg(s, ' ' ORDER BY i) AS page_content, any_value(title_path) AS title_path, any_value(title_level) AS title_level, min(block_index) AS reading_order, list_sort(list_distinct(list(block_index))) AS blocks, sum(length(s) // 4) AS tokens FROM parted GROUP BY source, run, g),
every AS (SELECT * FROM joined UNION ALL SELECT *, 0 FROM alone)"""
    return numbered(head.replace("WITH ", "WITH RECURSIVE ", 1) if ahead else head, "every", tokens="tokens")


def merged_groups(least: float) -> str:
    """parted: cuts with the numbers of groups that were joined; a group's vector is a difference of running sums."""
    group = lambda i: f"[x - sums[w.groups[{i}].a][j] for x, j in sums[w.groups[{i}].z + 1]]"
    return f"""dense AS (SELECT s.source, s.run, s.i, d.slot, coalesce(v.x, 0) AS x FROM sent s CROSS JOIN (SELECT unnest(range(64)) AS slot) d LEFT JOIN vec v ON v.source = s.source AND v.run = s.run AND v.i = s.i AND v.slot = d.slot),
running AS (SELECT source, run, i, slot, sum(x) OVER (PARTITION BY source, run, slot ORDER BY i) AS x FROM dense),
each_sum AS (SELECT source, run, i, list(x ORDER BY slot) AS v FROM running GROUP BY source, run, i),
prefix AS (SELECT source, run, list_prepend([0.0::DOUBLE for k in range(64)], list(v ORDER BY i)) AS sums FROM each_sum GROUP BY source, run),
first_groups AS (SELECT source, run, list({{'a': a, 'z': z}} ORDER BY a) AS groups FROM (SELECT source, run, g, min(i) AS a, max(i) AS z FROM cuts GROUP BY source, run, g) GROUP BY source, run),
walk AS (SELECT source, run, groups, true AS changed FROM first_groups
  UNION ALL SELECT source, run, made, len(made) < len(groups) FROM (SELECT w.source, w.run, w.groups, list_reduce(range(1, len(w.groups) + 1), lambda a, i: CASE WHEN a.used THEN {{'out': a.out, 'used': false}}
      WHEN i < len(w.groups) AND round(coalesce(list_cosine_similarity({group('i')}, {group('i + 1')}), 0), 9) >= {least} THEN {{'out': list_append(a.out, {{'a': w.groups[i].a, 'z': w.groups[i + 1].z}}), 'used': true}}
      ELSE {{'out': list_append(a.out, w.groups[i]), 'used': false}} END, {{'out': []::STRUCT(a BIGINT, z BIGINT)[], 'used': false}}).out AS made FROM walk w JOIN prefix p USING (source, run) WHERE w.changed)),
last_groups AS (SELECT source, run, unnest(groups) AS x, unnest(range(len(groups))) AS g FROM walk WHERE NOT changed),
parted AS (SELECT c.* EXCLUDE (g), l.g FROM cuts c JOIN last_groups l ON l.source = c.source AND l.run = c.run AND c.i BETWEEN l.x.a AND l.x.z)"""


def multipass(titles: str, content: str, size: int, base: str, levels: tuple[tuple[str, int], ...]) -> str:
    """every: base chunks and those of the levels above, with parent_index."""
    sql = f"""{sentences(titles, content, size, 0)},
g0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY o) - 1 AS k, kind, page_content, title_path, title_level, reading_order, blocks, [{place('b')} for b in blocks] AS places, CASE WHEN page_content <> '' THEN {count('page_content')} ELSE 0 END AS n FROM packed),
n0 AS (SELECT source, count(*) AS n, 0 AS before FROM g0 GROUP BY source)"""
    for j, (_, most) in enumerate(levels):
        single = f"(x.kind IN {EDGES})"
        sql += f""",
h{j} AS (SELECT source, list_reduce(list({{'k': k, 'kind': kind, 'n': n}} ORDER BY k), lambda a, x: CASE WHEN {single} OR NOT a.open OR a.total + x.n > {most} THEN {{'groups': list_append(a.groups, [x.k]), 'total': x.n, 'open': NOT {single}}}
    ELSE {{'groups': list_append(a.groups[:-2], list_append(a.groups[-1], x.k)), 'total': a.total + x.n, 'open': true}} END, {{'groups': []::BIGINT[][], 'total': 0::BIGINT, 'open': false}}).groups AS groups FROM g{j} GROUP BY source),
m{j} AS (SELECT source, unnest(flatten([[{{'k': k, 'g': i - 1}} for k in g] for g, i in groups])) AS x FROM h{j}),
g{j + 1} AS (SELECT c.source, x.g AS k, CASE WHEN count(*) = 1 THEN any_value(c.kind) ELSE 'text' END AS kind, string_agg(c.page_content, chr(10) || chr(10) ORDER BY c.k) AS page_content, arg_min(c.title_path, c.k) AS title_path, arg_min(c.title_level, c.k) AS title_level, arg_min(c.reading_order, c.k) AS reading_order,
    list_sort(list_distinct(flatten(list(c.blocks)))) AS blocks, flatten(list(c.places ORDER BY c.k)) AS places, {count("string_agg(c.page_content, chr(10) || chr(10) ORDER BY c.k)")} AS n FROM g{j} c JOIN m{j} m ON m.source = c.source AND m.x.k = c.k GROUP BY c.source, x.g),
n{j + 1} AS (SELECT g.source, count(*) AS n, any_value(p.before + p.n) AS before FROM g{j + 1} g JOIN n{j} p USING (source) GROUP BY g.source)"""
    parts = []
    for j, name in enumerate([base, *(n for n, _ in levels)]):
        parent = f"(SELECT q.before FROM n{j + 1} q WHERE q.source = g.source) + m.x.g" if j < len(levels) else "NULL"
        join = f"JOIN m{j} m ON m.source = g.source AND m.x.k = g.k" if j < len(levels) else ""
        parts.append(f"""SELECT g.source, (c.before + g.k)::INTEGER AS chunk_index, g.kind, g.page_content, g.title_path, g.title_level, g.reading_order, CASE WHEN g.k > 0 THEN c.before + g.k - 1 END::INTEGER AS prev_chunk_index, CASE WHEN g.k < c.n - 1 THEN c.before + g.k + 1 END::INTEGER AS next_chunk_index,
  '{name}' AS granularity, g.n::INTEGER AS token_count, array_to_string(g.blocks, ',') AS block_list, array_to_string(g.places, ';') AS position_list, ({parent})::INTEGER AS parent_index FROM g{j} g JOIN n{j} c USING (source) {join}""")
    return sql + ",\nevery AS (" + "\nUNION ALL ".join(parts) + ")"


def last_words(prompt: str, n: int) -> str:
    """A prompt's length and last words."""
    w = f"list_filter(regexp_split_to_array({prompt}, '{SP}+'), lambda w: w <> '')"
    return f"length({prompt}) || ' ' || array_to_string({w}[-{n}:], ' ')"
