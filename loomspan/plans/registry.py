"""Registered queries and the SQL that gives the same rows.

Arrays are written as text and doubles rounded, so that both engines' values compare as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import strings, tokens, vectors
from loomspan.operators import blocks as B
from loomspan.operators import chunkers as C
from loomspan.operators import context as X
from loomspan.operators import folds, joins, refine, similarity
from loomspan.plans import chunk_sql, fixtures
from loomspan.plans.fixtures import BLOCKS_SQL, VECTORS_SQL
from loomspan.sinks import chunks as S
from loomspan.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Java's and Python's white space for RE2.
SP = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def flat(c: Column | str) -> Column:
    """A list of numbers or texts as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def places(c: Column | str = "position_int") -> Column:
    return F.array_join(F.transform(c, lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), ";")


def chunk_rows(d: DataFrame) -> DataFrame:
    """A chunk's scalar columns, lists as text."""
    return d.select("source", "chunk_index", "kind", "page_content", "title_path", "title_level", "reading_order", "prev_chunk_index", "next_chunk_index", "granularity", "token_count", flat("block_indices").alias("block_list"), places().alias("position_list"), F.col("extras.parent_chunk_index").alias("parent_index"))


# --- sources and parsing -------------------------------------------------------------------------

@query(f"""
SELECT doc_id::VARCHAR AS source, part AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS block_index, 'text' AS kind
FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^{SP}+|{SP}+$', '', 'g') AS part, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM documents)
WHERE part <> ''""")
def blocks_from_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("value"))
    return B.blocks_from_text(d).select("source", "text", "block_index", "kind")


BLOCK_COLUMNS = "source, kind, text, page_idx, title_level, html, img_path, block_index, array_to_string(captions, '|') AS caption_list, array_to_string(bbox, ',') AS box"


@query(f"{BLOCKS_SQL} SELECT {BLOCK_COLUMNS} FROM blocks".replace("source, kind, text,", f"source, kind, CASE WHEN kind = 'table' THEN html WHEN kind = 'list' THEN regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') WHEN regexp_replace(text, '{SP}+', '', 'g') = '' THEN '' ELSE text END AS text,"))
def blocks_from_content_list(spark, sf_dir):
    d = B.blocks_from_content_list(fixtures.content_lists(spark, sf_dir))
    return d.select("source", "kind", "text", "page_idx", "title_level", "html", "img_path", "block_index", F.array_join("captions", "|").alias("caption_list"), flat("bbox").alias("box"))


LABELS = ["title", "DocItemLabel.SECTION_HEADER", "text", "list_item", "table", "picture", "formula", "page_footer", "nonsense"]


@query("""
WITH x AS (SELECT vec_id, ['title','DocItemLabel.SECTION_HEADER','text','list_item','table','picture','formula','page_footer','nonsense'][vec_id % 9 + 1] AS label, embedding FROM embeddings)
SELECT 'v:' || vec_id AS source, CASE WHEN vec_id % 9 IN (0, 1) THEN 'title' WHEN vec_id % 9 = 4 THEN 'table' WHEN vec_id % 9 = 5 THEN 'image' WHEN vec_id % 9 = 6 THEN 'equation' WHEN vec_id % 9 = 7 THEN 'discarded' ELSE 'text' END AS kind,
  k::INTEGER AS block_index, 0 AS reading_order, CASE WHEN vec_id % 9 = 0 THEN 1 WHEN vec_id % 9 = 1 THEN least(vec_id % 5 + 2, 6) ELSE 0 END::INTEGER AS title_level, k::INTEGER AS page_idx,
  concat_ws(',', trunc(((vec_id % 300)::DOUBLE / 600) * 1000)::INTEGER, trunc(CASE WHEN k = 0 THEN (800 - (400 + vec_id % 200)::DOUBLE) / 800 * 1000 ELSE (400 + vec_id % 200)::DOUBLE / 800 * 1000 END)::INTEGER,
    trunc(((300 + vec_id % 300)::DOUBLE / 600) * 1000)::INTEGER, trunc(CASE WHEN k = 0 THEN (800 - (vec_id % 400)::DOUBLE) / 800 * 1000 ELSE (vec_id % 400)::DOUBLE / 800 * 1000 END)::INTEGER) AS box
FROM x, (SELECT unnest([0, 1]) AS k)""")
def layout_items(spark, sf_dir):
    """Layout items with two provenances each, measured from the bottom and from the top."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    n = F.col("vec_id")
    num = lambda c: c.cast("double")
    prov = [F.struct(F.lit(k + 1).alias("page_no"), num(n % 300).alias("l"), num(400 + n % 200).alias("t"), num(300 + n % 300).alias("r"), num(n % 400).alias("b"), F.lit(o).alias("origin")) for k, o in enumerate(("CoordOrigin.BOTTOMLEFT", "TOPLEFT"))]
    item = F.struct(F.get(F.array(*map(F.lit, LABELS)), (n % 9).cast("int")).alias("label"), F.lit("t").alias("text"), (n % 5).cast("int").alias("level"), F.array(*prov).alias("prov"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"))
    d = e.select(F.concat(F.lit("v:"), n).alias("source"), F.to_json(F.array(item)).alias("content"))
    return B.blocks_from_layout_items(d).select("source", "kind", "block_index", "reading_order", "title_level", "page_idx", flat("bbox").alias("box"))


#: Suffixes, their MIME types, and how such files are read.
KINDS_OF_FILES = [
    (".PDF", "application/pdf", "parse"), (".txt", "text/plain", "text"), (".png", "image/png", "parse"), ("_content_list.json", "application/json", "json"), (".", "application/octet-stream", "unsupported"),
    (".gif", "image/gif", "unsupported"), (".doc", "application/msword", "unsupported"), (".jpg", "image/jpeg", "parse"), (".jpeg", "image/jpeg", "parse"), (".tiff", "image/tiff", "parse"), (".bmp", "image/bmp", "parse"), (".webp", "image/webp", "parse"),
    *((k, v, "parse") for k, v in files.OFFICE.items()), (".html", "text/html", "unsupported"), (".csv", "text/csv", "unsupported"), ("", "application/octet-stream", "unsupported"),
]


@query("SELECT page_id, [" + ", ".join(f"'{m}'" for _, m, _ in KINDS_OF_FILES) + f"][page_id % {len(KINDS_OF_FILES)} + 1] AS mime, [" + ", ".join(f"'{r}'" for _, _, r in KINDS_OF_FILES) + f"][page_id % {len(KINDS_OF_FILES)} + 1] AS route FROM pages")
def mime_and_route(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    suffix = F.get(F.array(*[F.lit(k) for k, _, _ in KINDS_OF_FILES]), (F.col("page_id") % len(KINDS_OF_FILES)).cast("int"))
    path = F.concat(F.lit("/data/v1.2/f"), "page_id", suffix)
    mime = files.mime_type(path)
    return p.select("page_id", mime.alias("mime"), files.route(path, mime).alias("route"))


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', '_')
  || CASE WHEN contains(regexp_extract(url, '^([^#]*)', 1), '?') THEN '_' || substr(sha256(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)), 1, 8) ELSE '' END || '.pdf' AS file_name
FROM pages""")
def web_file_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", strings.web_file_name(F.col("url"), "pdf").alias("file_name"))


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM events),
tree AS (SELECT event_id AS id, CASE WHEN event_id = 0 THEN NULL ELSE (event_id - 1) // 3 END AS parent_id, 3 * event_id < n AS is_folder, CASE WHEN 3 * event_id < n THEN 'd' || event_id ELSE event_type || '.pdf' END AS name FROM events, n),
down AS (SELECT id, name, is_folder, '' AS folder FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.name, t.is_folder, d.folder || '/' || d.name FROM tree t JOIN down d ON t.parent_id = d.id AND d.is_folder)
SELECT id, folder, name, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) = 1 THEN name ELSE regexp_replace(name, '[.]pdf$', '') || '_' || id || '.pdf' END AS local_name FROM down WHERE NOT is_folder""")
def listed_files(spark, sf_dir):
    """All events as a tree: the first third are folders of three."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, folder = F.col("event_id"), 3 * F.col("event_id") < e.count()
    return files.listed_files(e.select(i.alias("id"), F.when(i > 0, F.floor((i - 1) / 3)).alias("parent_id"), F.when(folder, F.concat(F.lit("d"), i)).otherwise(F.concat("event_type", F.lit(".pdf"))).alias("name"), folder.alias("is_folder")))


# --- filters and content -------------------------------------------------------------------------

@query(f"{BLOCKS_SQL} SELECT kind, count(*) AS n FROM blocks WHERE kind NOT IN ('table', 'equation', 'discarded') GROUP BY kind")
def kind_filter(spark, sf_dir):
    d = C.kept(B.keep_kinds(fixtures.blocks(spark, sf_dir), tables=False, equations=False), False)
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


CONTENT_SQL = "CASE WHEN text <> '' THEN text WHEN kind = 'table' AND html <> '' THEN html WHEN kind IN ('table', 'image') THEN array_to_string(captions, ' ') ELSE '' END"


@query(f"{BLOCKS_SQL} SELECT source, block_index, {CONTENT_SQL} AS content FROM blocks")
def page_content_fallback(spark, sf_dir):
    return fixtures.blocks(spark, sf_dir).select("source", "block_index", X.page_content().alias("content"))


TITLES_SQL = f"""{BLOCKS_SQL},
stacked AS (SELECT source, block_index, title_level AS level,
  list_reduce(list({{'l': title_level, 't': regexp_replace(text, '^{SP}+|{SP}+$', '', 'g')}}) OVER (PARTITION BY source ORDER BY block_index), lambda a, x: list_concat(a[1:greatest(x.l - 1, 0)], CASE WHEN x.t <> '' THEN [x.t] ELSE [] END), []::VARCHAR[]) AS stack
  FROM blocks WHERE kind = 'title'),
titled AS (SELECT b.* EXCLUDE (title_level), coalesce(array_to_string(last_value(s.stack IGNORE NULLS) OVER w, ' > '), '') AS title_path, coalesce(last_value(s.level IGNORE NULLS) OVER w, 0)::INTEGER AS title_level
  FROM blocks b LEFT JOIN stacked s USING (source, block_index) WINDOW w AS (PARTITION BY b.source ORDER BY b.block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"{TITLES_SQL} SELECT source, block_index, title_path, title_level FROM titled")
def title_breadcrumb(spark, sf_dir):
    return X.with_breadcrumb(fixtures.blocks(spark, sf_dir)).select("source", "block_index", "title_path", "title_level")


@query(f"{BLOCKS_SQL} SELECT source, block_index, sum((kind IN ('title', 'table', 'image', 'equation'))::INTEGER) OVER (PARTITION BY source ORDER BY block_index ROWS UNBOUNDED PRECEDING)::INTEGER AS section_id FROM blocks")
def section_ids(spark, sf_dir):
    return X.with_section(fixtures.blocks(spark, sf_dir)).select("source", "block_index", "section_id")


# --- chunkers ------------------------------------------------------------------------------------

BY_BLOCK_SQL = f"""{TITLES_SQL},
chunks AS (SELECT *, {CONTENT_SQL} AS page_content, (row_number() OVER (PARTITION BY source ORDER BY block_index) - 1)::INTEGER AS chunk_index FROM titled WHERE kind <> 'discarded'),
linked AS (SELECT *, (lag(chunk_index) OVER w)::INTEGER AS prev_chunk_index, (lead(chunk_index) OVER w)::INTEGER AS next_chunk_index, length(page_content) // 4 AS token_count,
  substr(sha256(source || chr(0) || chunk_index || chr(0) || page_content), 1, 16) AS content_hash FROM chunks WINDOW w AS (PARTITION BY source ORDER BY chunk_index))"""


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index, kind, page_content, title_path, title_level, prev_chunk_index, next_chunk_index, token_count::INTEGER AS token_count, content_hash, page_idx || ',' || array_to_string(bbox, ',') AS position_list FROM linked")
def by_block_chunks(spark, sf_dir):
    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)))
    return d.select("source", "chunk_index", "kind", "page_content", "title_path", "title_level", "prev_chunk_index", "next_chunk_index", "token_count", "content_hash", places().alias("position_list"))


@query(f"{BY_BLOCK_SQL} SELECT a.source, a.chunk_index, a.next_chunk_index, b.prev_chunk_index AS back FROM linked a JOIN linked b ON a.source = b.source AND a.next_chunk_index = b.chunk_index")
def chunk_links(spark, sf_dir):
    return joins.neighbors(C.ByBlock()(fixtures.blocks(spark, sf_dir)))


def token_sql(most: int, overlap: int) -> str:
    """Token windows in SQL: a fold over each section's blocks."""
    return f"""{TITLES_SQL},
kept AS (SELECT *, sum((kind IN ('title', 'table', 'image', 'equation') OR greatest(1, length(text) // 4) > {most})::INTEGER) OVER (PARTITION BY source ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS run,
  kind IN ('title', 'table', 'image', 'equation') OR greatest(1, length(text) // 4) > {most} AS alone, greatest(1, length(text) // 4) AS n FROM titled WHERE kind <> 'discarded'),
runs AS (SELECT source, run, list({{'i': block_index, 'n': n}} ORDER BY block_index) AS xs FROM kept WHERE NOT alone GROUP BY source, run),
folded AS (SELECT source, run, list_reduce(xs, lambda a, x: CASE WHEN a.total + x.n <= {most} THEN {{'done': a.done, 'buf': list_append(a.buf, x), 'total': a.total + x.n}}
    ELSE {{'done': CASE WHEN len(a.buf) > 0 THEN list_append(a.done, [b.i for b in a.buf]) ELSE a.done END,
      'buf': list_append(list_filter(a.buf, lambda b, k: list_sum([c.n for c in a.buf[k:]]) <= {overlap}), x),
      'total': coalesce(list_sum([b.n for b in list_filter(a.buf, lambda b, k: list_sum([c.n for c in a.buf[k:]]) <= {overlap})]), 0)::BIGINT + x.n}} END,
    {{'done': []::INTEGER[][], 'buf': []::STRUCT(i INTEGER, n BIGINT)[], 'total': 0::BIGINT}}) AS s FROM runs),
windows AS (SELECT source, run, unnest(list_append(s.done, [b.i for b in s.buf])) AS ids FROM folded),
merged AS (SELECT w.source, w.ids[1] AS first, len(w.ids) AS size, w.ids[len(w.ids)] AS last, array_to_string(w.ids, ',') AS block_list, string_agg(k.text, ' ' ORDER BY k.block_index) FILTER (k.text <> '') AS content, any_value(k.title_path) AS title_path
  FROM windows w JOIN kept k ON k.source = w.source AND list_contains(w.ids, k.block_index) GROUP BY w.source, w.ids),
every AS (SELECT source, last, first, 'text' AS kind, coalesce(content, '') AS page_content, title_path, block_list FROM merged
  UNION ALL SELECT source, block_index, block_index, kind, CASE WHEN kind IN ('title', 'table', 'image', 'equation') THEN {CONTENT_SQL} ELSE text END, title_path, block_index::VARCHAR FROM kept WHERE alone)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY last) - 1)::INTEGER AS chunk_index, kind, page_content, title_path, first AS reading_order, block_list FROM every"""


def _token_chunks(spark, sf_dir, most, overlap):
    return C.ByToken(most, overlap)(fixtures.blocks(spark, sf_dir)).select("source", "chunk_index", "kind", "page_content", "title_path", "reading_order", flat("block_indices").alias("block_list"))


@query(token_sql(512, 64))
def by_token_chunks(spark, sf_dir):
    return _token_chunks(spark, sf_dir, 512, 64)


@query(token_sql(200, 0))
def by_token_chunks_no_overlap(spark, sf_dir):
    return _token_chunks(spark, sf_dir, 200, 0)


SENTENCES_SQL = f"""
WITH cut AS (SELECT doc_id, text, list_filter([regexp_replace(p, '^{SP}+|{SP}+$', '', 'g') for p in string_split(regexp_replace(text, '([.] |! |[?] |\\n)', '\\1' || chr(57344) || chr(57345), 'g'), chr(57344) || chr(57345))], lambda p: length(p) >= 12) AS parts FROM documents),
whole AS (SELECT doc_id, CASE WHEN len(parts) > 0 THEN parts ELSE [regexp_replace(text, '^{SP}+|{SP}+$', '', 'g')] END AS parts FROM cut)
SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts)))::INTEGER AS pos FROM whole"""


@query(SENTENCES_SQL)
def sentence_split(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(strings.split_sentences(F.col("text"), folds.DELIMITERS, "prev", 12)).alias("pos", "sentence"))


@query(chunk_sql.numbered(chunk_sql.sentences(TITLES_SQL, CONTENT_SQL, 512, 64), "packed"))
def by_sentence_chunks(spark, sf_dir):
    return chunk_rows(C.BySentence(chunk_overlap=64)(fixtures.blocks(spark, sf_dir)))


@query(chunk_sql.recursive_chunks(TITLES_SQL, CONTENT_SQL, 128))
def by_recursive_chunks(spark, sf_dir):
    return chunk_rows(C.Recursive(chunk_size=128)(fixtures.blocks(spark, sf_dir)))


@query(chunk_sql.semantic_chunks(TITLES_SQL, CONTENT_SQL, 25.0))
def by_semantic_chunks(spark, sf_dir):
    return chunk_rows(C.Semantic()(fixtures.blocks(spark, sf_dir)))


@query(chunk_sql.semantic_chunks(TITLES_SQL, CONTENT_SQL, 25.0, 2))
def by_semantic_merged_chunks(spark, sf_dir):
    return chunk_rows(C.Semantic(skip_window=2)(fixtures.blocks(spark, sf_dir)))


@query(chunk_sql.guided_chunks(TITLES_SQL, CONTENT_SQL, 512, 128))
def guided_chunks(spark, sf_dir):
    return chunk_rows(C.Guided()(fixtures.blocks(spark, sf_dir)))


MULTIPASS_SQL = chunk_sql.multipass(TITLES_SQL, CONTENT_SQL, 150, "mini", (("normal", 512), ("large", 2048)))


@query(f"{MULTIPASS_SQL} SELECT * FROM every")
def multipass_chunks(spark, sf_dir):
    return chunk_rows(C.Multipass()(fixtures.blocks(spark, sf_dir)))


@query(f"{MULTIPASS_SQL} SELECT c.source, c.chunk_index, c.granularity, c.parent_index, p.granularity AS parent_granularity FROM every c JOIN every p ON p.source = c.source AND p.chunk_index = c.parent_index")
def parent_links(spark, sf_dir):
    return joins.parents(C.Multipass()(fixtures.blocks(spark, sf_dir)))


def grouped_sql(key: str, separator: str) -> str:
    return f"""{TITLES_SQL},
kept AS (SELECT *, {CONTENT_SQL} AS content, sum((kind = 'title')::INTEGER) OVER (PARTITION BY source ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS part FROM titled WHERE kind <> 'discarded'),
grouped AS (SELECT source, {key} AS k, min(block_index) AS first, coalesce(string_agg(content, '{separator}' ORDER BY block_index) FILTER (content <> ''), '') AS page_content, string_agg(block_index, ',' ORDER BY block_index) AS block_list, arg_min(title_path, block_index) AS title_path FROM kept GROUP BY source, {key})
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY first) - 1)::INTEGER AS chunk_index, page_content, block_list, title_path FROM grouped"""


@query(grouped_sql("page_idx", "\n"))
def by_page_chunks(spark, sf_dir):
    return C.ByPage()(fixtures.blocks(spark, sf_dir)).select("source", "chunk_index", "page_content", flat("block_indices").alias("block_list"), "title_path")


@query(grouped_sql("part", "\n\n"))
def by_section_chunks(spark, sf_dir):
    return C.BySection()(fixtures.blocks(spark, sf_dir)).select("source", "chunk_index", "page_content", flat("block_indices").alias("block_list"), "title_path")


@query(f"""{BLOCKS_SQL},
kept AS (SELECT *, kind IN ('title', 'table', 'image', 'equation') AS whole, sum((kind IN ('title', 'table', 'image', 'equation'))::INTEGER) OVER (PARTITION BY source ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS run FROM blocks WHERE kind <> 'discarded'),
runs AS (SELECT source, run, whole, string_agg(CASE WHEN whole THEN {CONTENT_SQL} ELSE text END, chr(10) ORDER BY block_index) AS t FROM kept GROUP BY source, run, whole),
cut AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE generate_series(0, greatest(length(t) - 1 - 50, 0), 250) END) AS begin_at FROM runs)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY run, NOT whole, begin_at) - 1)::INTEGER AS chunk_index, CASE WHEN whole THEN t ELSE substr(t, begin_at + 1, 300) END AS page_content FROM cut""")
def fixed_size_chunks(spark, sf_dir):
    return C.FixedSize(300, 50)(fixtures.blocks(spark, sf_dir)).select("source", "chunk_index", "page_content")


# --- enrichment ----------------------------------------------------------------------------------

@query(f"""SELECT doc_id, greatest(1, length(text) // 4)::INTEGER AS heuristic, (length(text) // 4)::INTEGER AS quarter, length(text)::INTEGER AS character,
  len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda x: x <> ''))::INTEGER AS word, strlen(text)::INTEGER AS byte FROM documents""")
def token_counts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", *[t.column(F.col("text")).alias(n) for n, t in tokens.BUILT_IN.items()])


@query("SELECT doc_id, substr(sha256(source || chr(0) || doc_id || chr(0) || text), 1, 16) AS hash FROM documents")
def content_hash(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", refine.content_hash("source", "doc_id", "text").alias("hash"))


@query(f"""{BY_BLOCK_SQL} SELECT source, chunk_index, CASE kind WHEN 'image' THEN 'Image' WHEN 'table' THEN 'Table' ELSE 'Équation' END || CASE WHEN title_path <> '' THEN ' — ' || title_path ELSE '' END || ' — p.' || (page_idx + 1) AS caption
FROM linked WHERE kind IN ('image', 'table', 'equation') AND len(captions) = 0""")
def inferred_captions(spark, sf_dir):
    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)))
    return d.filter("extras.inferred_caption is not null").select("source", "chunk_index", F.col("extras.inferred_caption").alias("caption"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 200) || ' […] ' || right(text, 295) END AS trimmed FROM documents")
def trim_middle(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", strings.trim_middle(F.col("text"), 500).alias("trimmed"))


@query(f"{BY_BLOCK_SQL} SELECT kind, count(*) AS n, count(*) FILTER (img_path <> '' AND kind <> 'image') AS with_image FROM linked GROUP BY kind")
def image_mode_skip(spark, sf_dir):
    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)), image_mode="skip")
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("extras.img_path").alias("with_image"))


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index, next_chunk_index FROM linked WHERE kind <> 'image'")
def image_mode_ignore(spark, sf_dir):
    return refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)), image_mode="ignore").select("source", "chunk_index", "next_chunk_index")


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index, kind FROM linked WHERE kind = 'image' AND len(captions) = 0")
def vision_targets(spark, sf_dir):
    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)))
    return d.filter(refine.needs_vision()).select("source", "chunk_index", "kind")


@query(f"""{BY_BLOCK_SQL}, t AS (SELECT source, coalesce(string_agg(page_content, chr(10) || chr(10) ORDER BY chunk_index) FILTER (regexp_replace(page_content, '{SP}+', '', 'g') <> ''), '') AS full_text FROM linked GROUP BY source)
SELECT source, full_text, CASE WHEN length(full_text) <= 24000 THEN full_text ELSE left(full_text, 9600) || ' […] ' || right(full_text, 14395) END AS doc_text FROM t""")
def document_texts(spark, sf_dir):
    return refine.document_texts(C.ByBlock()(fixtures.blocks(spark, sf_dir))).drop("granularity")


def first_words(prompt: str) -> str:
    """A stand-in for a model: the prompt's length and last words."""
    return f"{len(prompt)} {' '.join(prompt.split()[-3:])}"


def contextual_sql() -> str:
    put = lambda template, *values: " || ".join(x for pair in zip(["'" + t.replace("'", "''") + "'" for t in template.split("{}")], [*values, "''"]) for x in pair)
    return f"""{grouped_sql("part", "' || chr(10) || chr(10) || '").rpartition("SELECT")[0]},
c AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY first) - 1)::INTEGER AS chunk_index, page_content FROM grouped),
t AS (SELECT source, coalesce(string_agg(page_content, chr(10) || chr(10) ORDER BY chunk_index) FILTER ({chunk_sql.strip('page_content')} <> ''), '') AS full_text FROM c GROUP BY source),
d AS (SELECT source, full_text, CASE WHEN length(full_text) <= {refine.MOST_CHARS} THEN full_text ELSE left(full_text, 9600) || ' […] ' || right(full_text, 14395) END AS doc_text FROM t),
p AS (SELECT *, {put(refine.SUMMARY_PROMPT, "doc_text")} AS prompt FROM d),
s AS (SELECT source, full_text, {chunk_sql.last_words("prompt", 3)} AS doc_summary FROM p),
q AS (SELECT c.source, c.chunk_index, s.doc_summary, {chunk_sql.strip('c.page_content')} <> '' AS filled, {put(refine.CONTEXT_PROMPT, f"CASE WHEN length(s.full_text) > {refine.WHOLE_CHARS} THEN s.doc_summary ELSE s.full_text END", "c.page_content")} AS prompt FROM c JOIN s USING (source))
SELECT source, chunk_index, doc_summary, CASE WHEN filled THEN {chunk_sql.last_words("prompt", 3)} ELSE '' END AS chunk_context FROM q"""


@query(contextual_sql())
def contextual_chunks(spark, sf_dir):
    d = refine.add_context(refine.refine(C.BySection()(fixtures.blocks(spark, sf_dir))), first_words)
    return d.select("source", "chunk_index", "doc_summary", "chunk_context")


# --- similarity ----------------------------------------------------------------------------------

COS = "coalesce(list_cosine_similarity(a.vec, b.vec), 0)"


@query(f"{VECTORS_SQL} SELECT a.run_id, a.vec_id, round({COS}, 6) AS sim FROM vectors a JOIN vectors b ON a.run_id = b.run_id AND b.vec_id = a.vec_id + 1")
def pairwise_cosine(spark, sf_dir):
    return similarity.neighbor_similarity(fixtures.vectors(spark, sf_dir)).select("run_id", "vec_id", F.round("sim", 6).alias("sim"))


@query(f"{VECTORS_SQL} SELECT a.run_id, a.vec_id, round(max({COS}), 6) AS sim FROM vectors a JOIN vectors b ON a.run_id = b.run_id AND b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 GROUP BY a.run_id, a.vec_id")
def skip_window_similarity(spark, sf_dir):
    return similarity.neighbor_similarity(fixtures.vectors(spark, sf_dir), ahead=3).select("run_id", "vec_id", F.round("sim", 6).alias("sim"))


SIMS_SQL = f"{VECTORS_SQL}, sims AS (SELECT a.run_id, a.vec_id, {COS} AS sim FROM vectors a JOIN vectors b ON a.run_id = b.run_id AND b.vec_id = a.vec_id + 1)"


@query(f"{SIMS_SQL} SELECT run_id, vec_id, round(sum(sim) OVER (PARTITION BY run_id ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM sims")
def moving_average(spark, sf_dir):
    d = similarity.moving_average(similarity.neighbor_similarity(fixtures.vectors(spark, sf_dir)), 5)
    return d.select("run_id", "vec_id", F.round("smooth", 6).alias("smooth"))


def smooth_sql(window: int, degree: int) -> str:
    rows = vectors.savitzky_golay(window, degree)
    h = window // 2
    w = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in rows) + "]"
    return f"""{SIMS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM sims),
begun AS (SELECT *, least(greatest(i - {h}, 0), n - {window}) AS b FROM numbered)
SELECT a.run_id, a.vec_id, round(sum(c.sim * ({w}::DOUBLE[][])[a.i - a.b + 1][c.i - a.b + 1]), 6) AS smooth FROM begun a JOIN begun c ON a.run_id = c.run_id AND c.i BETWEEN a.b AND a.b + {window - 1} GROUP BY a.run_id, a.vec_id"""


@query(smooth_sql(5, 2))
def polynomial_smooth(spark, sf_dir):
    d = similarity.polynomial_smooth(similarity.neighbor_similarity(fixtures.vectors(spark, sf_dir)), 5, 2)
    return d.select("run_id", "vec_id", F.round("smooth", 6).alias("smooth"))


def minima_sql(window: int, degree: int, tolerance: float) -> str:
    h = window // 2
    w = ["[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in vectors.savitzky_golay(window, degree, k)) + "]::DOUBLE[][]" for k in range(3)]
    sums = ", ".join(f"round(sum(c.sim * ({w[k]})[a.i - a.b + 1][c.i - a.b + 1]), 9) AS d{k}" for k in range(3))
    return f"""{SIMS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM sims),
begun AS (SELECT *, least(greatest(i - {h}, 0), n - {window}) AS b FROM numbered),
fitted AS (SELECT a.run_id, a.vec_id, {sums} FROM begun a JOIN begun c ON a.run_id = c.run_id AND c.i BETWEEN a.b AND a.b + {window - 1} GROUP BY a.run_id, a.vec_id),
bound AS (SELECT run_id, quantile_cont(d0, 0.25) AS q FROM fitted GROUP BY run_id)
SELECT run_id, vec_id, abs(d1) < {tolerance} AND d2 > 0 AND d0 <= q + 1e-9 AS is_break FROM fitted JOIN bound USING (run_id)"""


@query(minima_sql(5, 3, 0.1))
def local_minima(spark, sf_dir):
    return similarity.local_minima(similarity.neighbor_similarity(fixtures.vectors(spark, sf_dir)), 5, 3).select("run_id", "vec_id", "is_break")


BREAKS_SQL = f"{SIMS_SQL}, bounds AS (SELECT run_id, quantile_cont(sim, 0.25) AS bound FROM sims GROUP BY run_id), marked AS (SELECT s.run_id, s.vec_id, s.sim < b.bound AS is_break FROM sims s JOIN bounds b USING (run_id))"


@query(f"{BREAKS_SQL} SELECT run_id, vec_id, is_break FROM marked")
def percentile_breakpoints(spark, sf_dir):
    return similarity.breakpoints(similarity.neighbor_similarity(fixtures.vectors(spark, sf_dir))).select("run_id", "vec_id", "is_break")


@query(f"{BREAKS_SQL} SELECT v.run_id, v.vec_id, coalesce(sum(is_break::INTEGER) OVER (PARTITION BY v.run_id ORDER BY v.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS segment FROM vectors v LEFT JOIN marked m ON v.run_id = m.run_id AND v.vec_id = m.vec_id")
def semantic_segments(spark, sf_dir):
    return similarity.segments(fixtures.vectors(spark, sf_dir)).select("run_id", "vec_id", "segment")


@query(f"{VECTORS_SQL} SELECT run_id, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM (SELECT run_id, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM vectors) GROUP BY run_id, pos")
def run_centroids(spark, sf_dir):
    d = similarity.centroids(fixtures.vectors(spark, sf_dir), "run_id")
    return d.select("run_id", "pos", F.round("mean", 6).alias("mean"))


# --- joins, reports, sinks -----------------------------------------------------------------------

@query(grouped_sql("page_idx", "\n").rpartition("SELECT")[0] + """, c AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY first) - 1)::INTEGER AS chunk_index, block_list FROM grouped),
refs AS (SELECT source, chunk_index, unnest(string_split(block_list, ','))::INTEGER AS block_index FROM c)
SELECT r.source, r.chunk_index, r.block_index, b.kind AS block_kind FROM refs r JOIN blocks b USING (source, block_index)""")
def chunk_to_blocks(spark, sf_dir):
    b = fixtures.blocks(spark, sf_dir)
    return joins.chunk_blocks(C.ByPage()(b), b)


@query(f"{BY_BLOCK_SQL} SELECT kind, count(*) AS n, min(token_count)::INTEGER AS least, max(token_count)::INTEGER AS most, round(avg(token_count), 6) AS mean FROM linked GROUP BY kind")
def kind_report(spark, sf_dir):
    d = joins.kind_report(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir))))
    return d.select("kind", "n", "least", "most", F.round("mean", 6).alias("mean"))


@query(f"{BY_BLOCK_SQL} SELECT DISTINCT a.source, a.page_idx AS page, a.chunk_index, b.chunk_index AS neighbor_index FROM linked a JOIN linked b ON a.source = b.source AND a.page_idx = b.page_idx AND a.chunk_index <> b.chunk_index AND b.bbox[2] >= a.bbox[4] AND b.bbox[2] - a.bbox[4] <= 60")
def spatial_neighbors(spark, sf_dir):
    return X.spatial_neighbors(C.ByBlock()(fixtures.blocks(spark, sf_dir)), 60)


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index FROM linked WHERE bbox[2] >= 200 AND bbox[2] < 500")
def zone_filter(spark, sf_dir):
    return X.zone(C.ByBlock()(fixtures.blocks(spark, sf_dir)), 200, 500).select("source", "chunk_index")


@query(f"{BY_BLOCK_SQL} SELECT source, page_idx AS page, string_agg(chunk_index || ':' || kind || ':' || array_to_string(bbox, ','), ';' ORDER BY chunk_index) AS boxes FROM linked GROUP BY source, page_idx")
def page_boxes(spark, sf_dir):
    d = S.page_boxes(C.ByBlock()(fixtures.blocks(spark, sf_dir)))
    return d.select("source", "page", F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", b["chunk_index"].cast("string"), b["kind"], F.array_join(F.transform(b["bbox"], lambda x: x.cast("string")), ","))), ";").alias("boxes"))


@query(f"""{BY_BLOCK_SQL} SELECT source, chunk_index, page_idx AS page, round(800 - bbox[4] * 0.8, 6)::DOUBLE AS x, round(bbox[1] * 0.6, 6)::DOUBLE AS y, round(abs(bbox[4] - bbox[2]) * 0.8, 6)::DOUBLE AS w, round(abs(bbox[3] - bbox[1]) * 0.6, 6)::DOUBLE AS h FROM linked""")
def pdf_rects(spark, sf_dir):
    d = S.pdf_rects(C.ByBlock()(fixtures.blocks(spark, sf_dir)), 600.0, 800.0, rotation=90)
    return d.select("source", "chunk_index", "page", *[F.round(c, 6).alias(c) for c in "xywh"])


@query(f"{BY_BLOCK_SQL} SELECT source, max(list_max(bbox)) <= 1001 AS normalized FROM linked GROUP BY source")
def coordinate_units(spark, sf_dir):
    return S.is_normalized(C.ByBlock()(fixtures.blocks(spark, sf_dir)))


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index, page_content, content_hash, title_path, kind FROM linked")
def jsonl_round_trip(spark, sf_dir):
    """Chunks written as JSON lines and parsed again."""
    from loomspan.schema import CHUNK

    lines = S.records(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir))))
    d = lines.select(F.from_json("value", CHUNK).alias("c")).select("c.*")
    return d.select("source", "chunk_index", "page_content", "content_hash", "title_path", "kind")


@query(f"{BY_BLOCK_SQL} SELECT page_content, content_hash, chunk_index, token_count::INTEGER AS token_count, CASE WHEN kind = 'table' THEN html END AS html FROM linked")
def langchain_records(spark, sf_dir):
    d = S.langchain(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir))))
    m = F.from_json("metadata", "content_hash string, chunk_index int, token_count int, html string")
    return d.select("page_content", m.alias("m")).select("page_content", "m.*")


@query(f"{BY_BLOCK_SQL} SELECT page_content AS text, source, title_path, NULL::VARCHAR AS position_int FROM linked")
def llamaindex_records(spark, sf_dir):
    d = S.llamaindex(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir))))
    return d.select("text", F.from_json("metadata", "source string, title_path string, position_int string").alias("m")).select("text", "m.*")
