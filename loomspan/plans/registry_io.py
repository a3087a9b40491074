"""Registered queries that go through files, formats, models and options, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid

from pyspark.sql import functions as F

from loomspan.functions import models, vectors
from loomspan.lineage import shared_folder
from loomspan.operators import blocks as B
from loomspan.operators import chunkers as C
from loomspan.operators import refine
from loomspan.plans import chunk_sql, fixtures, ingest
from loomspan.plans.fixtures import BLOCKS_SQL
from loomspan.plans.registry import BY_BLOCK_SQL, CONTENT_SQL, MULTIPASS_SQL, SP, TITLES_SQL, flat, query
from loomspan.sinks import chunks as S
from loomspan.sources import drive, files


def new_folder(spark) -> str:
    """A new local folder below the shared one."""
    path = os.path.join(shared_folder(spark).removeprefix("file://"), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def nation_files(spark, sf_dir: str) -> str:
    """A folder with a text file for each nation, in a folder for each region; region 0's lie at the top."""
    folder = new_folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    for r in rows.collect():
        at = os.path.join(folder, r["r_name"]) if r["n_regionkey"] else folder
        os.makedirs(at, exist_ok=True)
        with open(os.path.join(at, f"{r['n_name']}.txt"), "w", encoding="utf-8") as f:
            f.write(f"{r['n_name']}\n\n  lies in {r['r_name']}.  \n\n\n\nNo. {r['n_nationkey']}\nof all")
    return folder


NATIONS_SQL = "WITH n AS (SELECT CASE WHEN n_regionkey = 0 THEN '' ELSE r_name || '/' END || n_name || '.txt' AS file, n_name, r_name, n_regionkey, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


def below(folder: str, c: str = "source"):
    return F.regexp_replace(c, f"^(file:/*)?{os.path.realpath(folder)}/", "").alias("file")


@query(f"{NATIONS_SQL} SELECT file, 'text/plain' AS mime_type, 'yes' AS tag FROM n")
def fetched_folder(spark, sf_dir):
    folder = nation_files(spark, sf_dir)
    d = files.fetch(spark, folder=folder, metadata={"tag": "yes"})
    return d.select(below(folder), "mime_type", F.element_at("metadata", "tag").alias("tag"))


@query(f"{NATIONS_SQL} SELECT file, 'text/plain' AS mime_type FROM n WHERE n_regionkey = 0")
def fetched_top_folder(spark, sf_dir):
    folder = nation_files(spark, sf_dir)
    return files.fetch(spark, folder=folder, extensions=["TXT"], recursive=False).select(below(folder), "mime_type")


@query(f"{NATIONS_SQL} SELECT min(file) AS file, 'text/plain' AS mime_type, 'by name' AS way FROM n WHERE n_regionkey = 0 UNION ALL SELECT min(file), 'text/plain', 'by path' FROM n WHERE n_regionkey = 0")
def fetched_file(spark, sf_dir):
    folder = nation_files(spark, sf_dir)
    first = min(f for f in os.listdir(folder) if f.endswith(".txt"))
    one = files.fetch_named(spark, folder, first).withColumn("way", F.lit("by name"))
    return one.unionByName(files.fetch(spark, path=os.path.join(folder, first)).withColumn("way", F.lit("by path"))).select(below(folder), "mime_type", "way")


@query(f"{NATIONS_SQL}, p AS (SELECT file, unnest([n_name, 'lies in ' || r_name || '.', 'No. ' || n_nationkey || chr(10) || 'of all']) AS page_content, unnest([0, 1, 2])::INTEGER AS chunk_index FROM n) SELECT * FROM p")
def ingested_folder(spark, sf_dir):
    folder = nation_files(spark, sf_dir)
    return ingest.ingest(spark, folder, "by_block").select(below(folder), "page_content", "chunk_index")


def content_list_file(spark, sf_dir: str) -> str:
    """A parser's output folder: a content list with a title for each region and a text for each nation, and another, later by name."""
    folder, items = new_folder(spark), []
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    for r in sorted(spark.read.parquet(f"{sf_dir}/region.parquet").collect(), key=lambda r: r["r_regionkey"]):
        items.append({"type": "text", "text_level": 1, "text": r["r_name"], "page_idx": r["r_regionkey"], "bbox": [0, 0, 10, 10]})
        items += [{"type": "text", "text": n["n_name"], "page_idx": r["r_regionkey"]} for n in sorted(nations, key=lambda n: n["n_nationkey"]) if n["n_regionkey"] == r["r_regionkey"]]
    for name, value in (("a_content_list.json", items), ("b_content_list.json", [])):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump(value, f)
    return folder


ITEMS_SQL = """WITH items AS (SELECT r_regionkey AS page, -1 AS n, r_name AS t, 'title' AS kind, r_name AS title_path FROM region UNION ALL SELECT r_regionkey, n_nationkey, n_name, 'text', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT (row_number() OVER (ORDER BY page, n) - 1)::INTEGER AS chunk_index, kind, t AS page_content, title_path, page::INTEGER AS page_idx FROM items"""


def _items(d):
    return d.select("chunk_index", "kind", "page_content", "title_path", F.get(F.get("position_int", F.lit(0)), F.lit(0)).alias("page_idx"))


@query(ITEMS_SQL)
def ingested_parser_output(spark, sf_dir):
    return _items(ingest.ingest_from_output(spark, content_list_file(spark, sf_dir), "by_block"))


@query(ITEMS_SQL)
def ingested_parser_folder(spark, sf_dir):
    return _items(ingest.ingest(spark, content_list_file(spark, sf_dir), "by_block"))


@query(ITEMS_SQL)
def ingested_json(spark, sf_dir):
    return _items(ingest.ingest_from_json(spark, os.path.join(content_list_file(spark, sf_dir), "a_content_list.json"), "by_block"))


@query(f"{NATIONS_SQL} SELECT 'drive:' || file AS path FROM n")
def drive_files(spark, sf_dir):
    """A drive with a folder for each region, listed two items a page and downloaded."""
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).collect()]
    at: dict[str, list] = {"": []}
    for r in rows:
        k = r["r_name"] if r["n_regionkey"] else ""
        if k not in at:
            at[k] = []
            at[""].append({"id": f"dir-{k}", "name": k, "folder": {}})
        at[k].append({"id": r["n_name"], "name": f"{r['n_name']}.txt", "file": {}})

    def get(url: str, token: str) -> dict:
        assert token == "t"
        u = urllib.parse.urlparse(url)
        if u.path.endswith("/sites"):
            return {"value": [{"id": "site"}]}
        if u.path.endswith("/drive"):
            return {"id": "d"}
        k = "" if "root/children" in u.path else u.path.split("/items/dir-")[1].split("/")[0]
        skip = int(urllib.parse.parse_qs(u.query).get("skip", ["0"])[0])
        more = {"@odata.nextLink": f"{url.split('?')[0]}?skip={skip + 2}"} if skip + 2 < len(at[k]) else {}
        return {"value": at[k][skip : skip + 2], **more}

    folder = {r["n_name"]: (r["r_name"] + "/" if r["n_regionkey"] else "") for r in rows}
    target = new_folder(spark)
    d = drive.Drive("http://api", "t", get, lambda url, token: url.split("/items/")[1].split("/")[0].encode())
    got = files.read_rows(d.download(spark, d.site_id(name="x"), target))
    where = F.create_map(*[F.lit(v) for kv in folder.items() for v in kv])
    return got.select(F.concat(F.lit("drive:"), F.element_at(where, F.col("value")), F.regexp_extract("source", "[^/]*$", 0)).alias("path"))


# --- options of the pipeline, formats ------------------------------------------------------------

@query(f"""{TITLES_SQL}, few AS (SELECT * FROM titled WHERE kind NOT IN ('table', 'equation', 'discarded') AND kind <> 'list'),
c AS (SELECT *, {CONTENT_SQL} AS page_content, (row_number() OVER (PARTITION BY source ORDER BY block_index) - 1)::INTEGER AS chunk_index FROM few)
SELECT page_content, source, kind, chunk_index, octet_length(encode(page_content))::INTEGER AS token_count, CASE WHEN kind = 'image' AND len(captions) = 0 THEN 'Image' || CASE WHEN title_path <> '' THEN ' — ' || title_path ELSE '' END || ' — p.' || (page_idx + 1) END AS caption FROM c""")
def run_pipeline(spark, sf_dir):
    """Kinds filtered before chunking by switches and by a condition, a tokenizer by name, records of a framework."""
    d = ingest.run(fixtures.blocks(spark, sf_dir), "by_block", output="langchain", tables=False, equations=False, tokenizer="byte", where=F.col("kind") != "list")
    m = F.from_json("metadata", "source string, kind string, chunk_index int, token_count int, inferred_caption string")
    return d.select("page_content", m.alias("m")).select("page_content", "m.source", "m.kind", "m.chunk_index", "m.token_count", F.col("m.inferred_caption").alias("caption"))


@query(f"{BY_BLOCK_SQL}, names AS (SELECT unnest(['by_block', 'by_page', 'by_section', 'fixed_size', 'by_token', 'by_sentence', 'by_recursive', 'recursive', 'by_semantic', 'semantic', 'by_slumber', 'slumber', 'guided', 'multipass']) AS strategy) SELECT strategy, count(DISTINCT source) AS n_sources, bool_and(chunk_index >= 0) AS numbered FROM linked, names GROUP BY strategy")
def strategies(spark, sf_dir):
    """Every strategy by each of its names: all sources come out of it, numbered."""
    names: dict[C.Chunker, list[str]] = {}
    for name in C.STRATEGIES:
        names.setdefault(C.chunker(name), []).append(name)  # equal chunkers make the same chunks
    d = C.numbers(fixtures.blocks(spark, sf_dir), {n[0]: c for c, n in names.items()})
    d = d.groupBy("strategy").agg(F.countDistinct("source").alias("n_sources"), F.bool_and(F.col("chunk_index") >= 0).alias("numbered"))
    every = F.create_map(*[x for n in names.values() for x in (F.lit(n[0]), F.array(*map(F.lit, n)))])
    return d.select(F.explode(F.element_at(every, F.col("strategy"))).alias("strategy"), "n_sources", "numbered")


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index, page_content, title_path, kind, token_count::INTEGER AS token_count, md5(source || chr(0) || chunk_index || chr(0) || page_content) AS content_hash FROM linked")
def jsonl_files(spark, sf_dir):
    """Chunks with a hash of one's own, written as JSON lines into files and read again."""
    path = os.path.join(new_folder(spark), "chunks")
    S.write_jsonl(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)), hasher=F.md5), "file://" + path)
    return S.read_jsonl(spark, "file://" + path).select("source", "chunk_index", "page_content", "title_path", "kind", "token_count", "content_hash")


@query(f"{BY_BLOCK_SQL} SELECT row_number() OVER (ORDER BY source, chunk_index) - 1 AS place, source, chunk_index, page_content FROM linked")
def json_array_file(spark, sf_dir):
    """One file with a JSON array, in the order of source and index, parsed again."""
    path = os.path.join(new_folder(spark), "chunks.json")
    blocks = fixtures.blocks(spark, sf_dir).repartitionByRange("source")  # the one shuffle, for the breadcrumbs and for the order of the file
    S.write_json_array(C.ByBlock()(blocks), path)
    return S.read_json_array(spark, path).select("place", "source", "chunk_index", "page_content")


@query(f"{BY_BLOCK_SQL} SELECT source, chunk_index, kind, coalesce(html, '') AS html FROM linked")
def dict_records(spark, sf_dir):
    d = S.formatted(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir))), "dicts")
    r = F.from_json("value", "source string, chunk_index int, kind string, extras struct<html string>").alias("r")
    return d.select(r).select("r.source", "r.chunk_index", "r.kind", F.coalesce("r.extras.html", F.lit("")).alias("html"))


@query(f"{MULTIPASS_SQL} SELECT source, chunk_index, page_content, token_count FROM every WHERE granularity = 'normal'")
def granularity_filter(spark, sf_dir):
    return C.Multipass()(fixtures.blocks(spark, sf_dir)).filter("granularity = 'normal'").select("source", "chunk_index", "page_content", "token_count")


@query(f"""{MULTIPASS_SQL}, ids AS (SELECT source, chunk_index, granularity, unnest(string_split(block_list, ','))::INTEGER AS block_index FROM every),
x AS (SELECT i.source, i.chunk_index, i.block_index, b.html, b.img_path, b.captions FROM ids i JOIN blocks b USING (source, block_index) WHERE b.kind IN ('table', 'image'))
SELECT source, chunk_index, coalesce(arg_min(html, block_index) FILTER (html <> ''), '') AS html, coalesce(arg_min(img_path, block_index) FILTER (img_path <> ''), '') AS img_path, coalesce(string_agg(captions[1], '|' ORDER BY block_index) FILTER (len(captions) > 0), '') AS caption_list FROM x GROUP BY source, chunk_index""")
def multipass_extras(spark, sf_dir):
    """What coarser chunks take over: the first html and image, all captions."""
    d = C.Multipass()(fixtures.blocks(spark, sf_dir))
    e = lambda c: F.coalesce(F.col(f"extras.{c}"), F.lit(""))
    d = d.select("source", "chunk_index", e("html").alias("html"), e("img_path").alias("img_path"), F.coalesce(F.array_join("extras.captions", "|"), F.lit("")).alias("caption_list"))
    return d.filter("html <> '' or img_path <> ''")


# --- parsing, images, models ---------------------------------------------------------------------

@query("""
WITH x AS (SELECT page_id, ['Title', 'LabelType.TABLE', 'DocItemLabel.picture', 'page_header', 'paragraph', 'formula'][page_id % 6 + 1] AS label, url FROM pages)
SELECT 'p:' || page_id AS source, ['title', 'table', 'image', 'discarded', 'text', 'equation'][page_id % 6 + 1] AS kind, url AS text, (page_id % 4)::INTEGER AS page_idx, (page_id % 3)::INTEGER AS title_level, CASE WHEN page_id % 2 = 0 THEN '<t/>' ELSE '' END AS html, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'c' END AS caption_list FROM x""")
def layout_list(spark, sf_dir):
    """Plain layout dicts, some keys absent or null."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    i = F.col("page_id")
    item = F.struct(F.get(F.array(*map(F.lit, ("Title", "LabelType.TABLE", "DocItemLabel.picture", "page_header", "paragraph", "formula"))), (i % 6).cast("int")).alias("label"), F.col("url").alias("text"), (i % 4).alias("page_idx"), (i % 3).alias("title_level"), F.when(i % 2 == 0, "<t/>").alias("html"), F.when(i % 5 != 0, F.array(F.lit("c"))).alias("captions"))
    d = p.select(F.concat(F.lit("p:"), i).alias("source"), F.to_json(F.array(item)).alias("content"))
    return B.blocks_from_layout_list(d).select("source", "kind", "text", "page_idx", "title_level", "html", F.array_join("captions", "|").alias("caption_list"))


IMAGES_SQL = f"{BY_BLOCK_SQL}, i AS (SELECT source, chunk_index, img_path, block_index FROM linked WHERE kind = 'image')"


def image_files(spark, sf_dir: str):
    """(path, content): every second image of the blocks, as if read from /base; its content is its path."""
    d = fixtures.blocks(spark, sf_dir).filter("kind = 'image' and block_index % 32 = 8")
    path = F.concat(F.lit("/base/"), "img_path")
    return d.select(F.concat(F.lit("file:"), path).alias("path"), F.encode(path, "UTF-8").alias("content"))


@query(f"{IMAGES_SQL} SELECT source, chunk_index, CASE WHEN block_index % 32 = 8 THEN '/base/' || img_path ELSE img_path END AS img_path FROM i")
def image_paths(spark, sf_dir):
    """Paths of images that exist are resolved; the others stay, as paths that aren't."""
    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)), images=image_files(spark, sf_dir), base_dir="/base")
    return d.filter("kind = 'image'").select("source", "chunk_index", F.col("extras.img_path").alias("img_path"))


@query(f"{IMAGES_SQL} SELECT source, chunk_index, 'data:image/jpeg;base64,' || base64(encode('/base/' || img_path)) AS data FROM i WHERE block_index % 32 = 8")
def image_data(spark, sf_dir):
    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)), images=image_files(spark, sf_dir), base_dir="/base", image_mode="base64")
    return d.filter("extras.image_b64 is not null").select("source", "chunk_index", F.col("extras.image_b64").alias("data"))


@query(f"{IMAGES_SQL}, l AS (SELECT source, chunk_index, img_path FROM i WHERE block_index % 32 = 8 AND len('data:image/jpeg;base64,' || base64(encode('/base/' || img_path))) % 8 <> 3) SELECT source, chunk_index, 'seen ' || len('data:image/jpeg;base64,' || base64(encode('/base/' || img_path))) AS page_content FROM l")
def vision_answers(spark, sf_dir):
    """A stand-in that fails on some images: what it says takes the content's place, failures leave it."""

    def look(prompt: str, image: str) -> str:
        if len(image) % 8 == 3:
            raise ValueError("not seen")
        return f" seen {len(image)} "

    d = refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir)), images=image_files(spark, sf_dir), base_dir="/base", image_mode="base64")
    return refine.add_vision(d, look, only_empty=False).filter("page_content like 'seen %'").select("source", "chunk_index", "page_content")


@query(f"""{BY_BLOCK_SQL}, c AS (SELECT source, chunk_index, page_content, {chunk_sql.strip('page_content')} <> '' AS filled FROM linked)
SELECT source, chunk_index, CASE WHEN filled AND length(page_content) % 3 > 0 THEN 'ok' ELSE '' END AS chunk_context FROM c""")
def failing_model(spark, sf_dir):
    """A model that fails on some passages: they have no context."""

    def ask(prompt: str) -> str:
        passage = prompt.split("A passage of it:\n\n", 1)[1].rsplit("\n\nSay in one or two sentences", 1)[0]
        if len(passage) % 3 == 0:
            raise RuntimeError("busy")
        return "ok"

    d = refine.add_context(refine.refine(C.ByBlock()(fixtures.blocks(spark, sf_dir))), ask, summary=False)
    return d.select("source", "chunk_index", "chunk_context")


@query("SELECT event_id, (CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN event_id ELSE NULL END)::BIGINT AS choice FROM events")
def split_answers(spark, sf_dir):
    """The number that a model's answer names: in JSON, in a sentence, the first of several, none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u, i = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    forms = [F.concat(F.lit('{"split_index": '), u, F.lit("}")), F.concat(F.lit("I would split at ID "), u, F.lit(".")), F.concat(F.lit('{"other": '), i, F.lit("} or 7")), F.lit("no idea")]
    answer = F.when(F.col("event_id") % 4 == 0, forms[0]).when(F.col("event_id") % 4 == 1, forms[1]).when(F.col("event_id") % 4 == 2, forms[2]).otherwise(forms[3])

    @F.pandas_udf("long")
    def named(answers):
        return answers.map(models.split_index).astype("Int64")

    return e.select("event_id", named(answer).alias("choice"))


@query(f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT w, {chunk_sql.crc32('w')} AS h FROM (SELECT DISTINCT w FROM w)),
adds AS (SELECT doc_id, h % 64 AS slot, 1 AS x FROM w JOIN h USING (w) UNION ALL SELECT doc_id, (h >> 16) % 64, CASE WHEN h & 32768 > 0 THEN -1 ELSE 1 END FROM w JOIN h USING (w)),
v AS (SELECT doc_id, slot, sum(x) AS x FROM adds GROUP BY doc_id, slot)
SELECT d.doc_id, coalesce(string_agg(CASE WHEN x <> 0 THEN slot || ':' || x END, ',' ORDER BY slot), '') AS vec FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id""")
def embedded_texts(spark, sf_dir):
    """The built-in embedder's vectors, as the places that aren't 0."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", vectors.embedding(F.col("text")).alias("v"))
    places = F.filter(F.transform("v", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), x.cast("int").cast("string")))), lambda x: x.isNotNull())
    return d.select("doc_id", F.array_join(places, ",").alias("vec"))


@query(f"{BLOCKS_SQL} SELECT source, list_first(list(block_index ORDER BY block_index) FILTER ({chunk_sql.strip('text')} <> '')) AS first_filled, string_agg(block_index, ',' ORDER BY block_index) FILTER ({chunk_sql.strip('text')} = '' AND kind NOT IN ('table', 'image', 'discarded')) AS blanks FROM blocks GROUP BY source")
def blank_texts(spark, sf_dir):
    """Blocks that chunkers of text pass over."""
    from loomspan.functions.strings import strip

    b = fixtures.blocks(spark, sf_dir)
    empty = strip(F.col("text")) == ""
    skipped = F.array_sort(F.collect_list(F.when(empty & ~F.col("kind").isin("table", "image", "discarded"), F.col("block_index"))))
    return b.groupBy("source").agg(F.min(F.when(~empty, F.col("block_index"))).alias("first_filled"), F.when(F.size(skipped) > 0, flat(skipped)).alias("blanks"))
