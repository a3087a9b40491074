"""Enrichment of chunks: counts, hashes, images, captions, model-made context."""

from __future__ import annotations

import base64
import mimetypes
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import tokens
from loomspan.functions.strings import filled, strip, trim_middle, trim_middle_py

IMAGE_MODES = ("path", "base64", "skip", "ignore")
#: Characters of text that go to a model at most, and up to which a whole document goes along.
MOST_CHARS, WHOLE_CHARS = 24_000, 8_000
SUMMARY_PROMPT = "Summarize this document in a few sentences, naming its subject and purpose.\n\n{}\n"
CONTEXT_PROMPT = "A document:\n\n{}\n\nA passage of it:\n\n{}\n\nSay in one or two sentences how the passage fits into the document. Answer with these sentences only.\n"
VISION_PROMPTS = {"image": "Describe this image and transcribe its text.", "table": "Transcribe this table as Markdown."}


def content_hash(source: Column | str = "source", index: Column | str = "chunk_index", content: Column | str = "page_content") -> Column:
    """16 hex digits of SHA-256 over source, chunk index and content, parted by NUL."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (source, index, content)]
    return F.substring(F.sha2(hash_key(*parts), 256), 1, 16)


def hash_key(source: Column, index: Column, content: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce(source, empty), F.lit("\0"), F.coalesce(index.cast("string"), empty), F.lit("\0"), F.coalesce(content, empty))


def inferred_caption() -> Column:
    """"Image — breadcrumb — p.3" for images, tables and equations without captions, else null."""
    label = F.when(F.col("kind") == "image", "Image").when(F.col("kind") == "table", "Table").when(F.col("kind") == "equation", "Équation")
    section = F.when(F.col("title_path") != "", F.concat(F.lit(" — "), "title_path")).otherwise("")
    page = F.coalesce((F.get(F.get("position_int", F.lit(0)), F.lit(0)) + 1).cast("string"), F.lit("?"))
    none = F.coalesce(F.size("extras.captions"), F.lit(0)) <= 0
    return F.when(none & label.isNotNull(), F.concat(label, section, F.lit(" — p."), page))


def image_path(base_dir: str | None) -> Column:
    """The image's path under ``base_dir``, or under the folder of its source."""
    base = F.lit(base_dir.rstrip("/")) if base_dir else F.regexp_extract("source", r"^(.*)/[^/]*$", 1)
    path = filled(F.col("extras.img_path"))
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(base, F.lit("/"), path))


def refine(chunks: DataFrame, tokenizer: object = "quarter", hasher: Callable[[Column], Column] | None = None, image_mode: str = "path", base_dir: str | None = None, captions: bool = True, images: DataFrame | None = None) -> DataFrame:
    """Sets token_count, content_hash, image extras and inferred captions.

    ``hasher`` makes a Column of the column source NUL index NUL content. ``images``: (path, content)
    as Spark's binaryFile reads them; with it, image paths that exist there are resolved
    (mode "path") or added as data URIs ("base64"). "skip" takes paths and data away, "ignore" takes
    image chunks away, leaving gaps in the numbers.
    """
    if image_mode not in IMAGE_MODES:
        raise ValueError(f"image_mode must be one of {IMAGE_MODES}")
    d = chunks.filter("kind <> 'image'") if image_mode == "ignore" else chunks
    key = hash_key(F.col("source"), F.col("chunk_index"), F.col("page_content"))
    d = d.withColumns({"token_count": tokens.resolve(tokenizer).column(F.col("page_content")), "content_hash": hasher(key) if hasher else content_hash()})
    image = F.col("kind") == "image"
    if image_mode == "skip":
        d = d.withColumn("extras", F.when(image, F.col("extras").withField("img_path", F.lit(None).cast("string")).withField("image_b64", F.lit(None).cast("string"))).otherwise(F.col("extras")))
    elif images is not None and image_mode in ("path", "base64"):
        found = images.select(F.regexp_replace("path", "^file:/*", "/").alias("_found"), *([F.base64("content").alias("_data")] if image_mode == "base64" else []))
        # rows that want no image have a null key; by the second key they are spread, by
        # source and thousands, instead of meeting in one task
        d = d.withColumn("_want", F.when(image, image_path(base_dir)))
        d = d.withColumn("_spread", F.when(F.col("_want").isNull(), F.xxhash64("source", "granularity", F.floor(F.col("chunk_index") / 1000))).otherwise(F.xxhash64("_want")))
        d = d.join(found.withColumn("_at", F.xxhash64("_found")), (F.col("_want") == F.col("_found")) & (F.col("_spread") == F.col("_at")), "left")
        if image_mode == "path":
            new = F.col("extras").withField("img_path", F.col("_found"))
        else:
            mime = F.when(F.lower("_found").endswith(".png"), "image/png").when(F.lower("_found").endswith(".gif"), "image/gif").when(F.lower("_found").endswith(".webp"), "image/webp").otherwise("image/jpeg")
            new = F.col("extras").withField("image_b64", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace("_data", r"\s", "")))
        d = d.withColumn("extras", F.when(F.col("_found").isNotNull(), new).otherwise(F.col("extras"))).select(chunks.columns)
    if captions:
        d = d.withColumn("extras", F.col("extras").withField("inferred_caption", F.coalesce(inferred_caption(), F.col("extras.inferred_caption"))))
    return d.select(chunks.columns)


def document_texts(chunks: DataFrame) -> DataFrame:
    """(source, granularity, full_text, doc_text): the non-blank contents in order, and cut in the middle."""
    rows = F.array_sort(F.collect_list(F.when(strip(F.col("page_content")) != "", F.struct("chunk_index", "page_content"))))
    d = chunks.groupBy("source", "granularity").agg(rows.alias("_rows")).withColumn("full_text", F.array_join(F.transform("_rows", lambda r: r["page_content"]), "\n\n"))
    return d.select("source", "granularity", "full_text", trim_middle(F.col("full_text"), MOST_CHARS).alias("doc_text"))


def _asked(model: object, on_error: str) -> Callable[[str], str]:
    generate = getattr(model, "generate", model)
    if not callable(generate):
        raise TypeError("a model must be callable or have generate()")

    def ask(prompt: str) -> str:
        try:
            return generate(prompt) or ""
        except Exception:
            if on_error == "raise":
                raise
            return ""

    return ask


def add_context(chunks: DataFrame, model: object, summary: bool = True, context: bool = True, on_error: str = "skip", workers: int = 4) -> DataFrame:
    """Sets doc_summary and chunk_context by a model: any callable, or an object with generate().

    One summary for each document (and granularity); one context for each chunk that isn't blank,
    given the whole text of a short document, else its summary, else its text cut in the middle. If the
    model has generate_contextual(), it gets the part of the prompt that a document's chunks share apart.

    A document's chunks meet in one task, in order, by one shuffle: its text is put together there, once, and
    isn't copied to its chunks. A task holds one document at a time, besides a batch.
    """
    ask = _asked(model, on_error)
    with_shared = getattr(model, "generate_contextual", None)
    shared, own = CONTEXT_PROMPT.split("A passage of it:", 1)

    def place(info: str, content: str) -> str:
        if with_shared is None:
            return ask(CONTEXT_PROMPT.format(info, content))
        return _asked(lambda p: with_shared(shared.format(info), p), on_error)("A passage of it:" + own.format(content))

    def answered(pool: ThreadPoolExecutor, t: pa.Table) -> pa.RecordBatch:
        names = list(zip(t["source"].to_pylist(), t["granularity"].to_pylist()))
        contents, some = t["page_content"].to_pylist(), []
        docs: dict = {}
        for k, c in zip(names, contents):
            docs.setdefault(k, []).append(c)
            some.append(bool((c or "").strip()))
        whole = {k: "\n\n".join(c for c in v if (c or "").strip()) for k, v in docs.items()}
        wanted = [k for k, v in whole.items() if summary or (context and len(v) > WHOLE_CHARS)]
        found = dict(zip(wanted, pool.map(lambda k: ask(SUMMARY_PROMPT.format(trim_middle_py(whole[k], MOST_CHARS))), wanted)))
        if summary:
            new = [found[k] or old for k, old in zip(names, t["doc_summary"].to_pylist())]
            t = t.set_column(t.column_names.index("doc_summary"), "doc_summary", pa.array(new, pa.string()))
        if context:
            info = {k: v if len(v) <= WHOLE_CHARS else found[k] or trim_middle_py(v, MOST_CHARS) for k, v in whole.items()}
            said = pool.map(lambda x: place(info[x[0]], x[1]) if x[2] else "", zip(names, contents, some))
            new = [a or old for a, old in zip(said, t["chunk_context"].to_pylist())]
            t = t.set_column(t.column_names.index("chunk_context"), "chunk_context", pa.array(new, pa.string()))
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            held: list[pa.RecordBatch] = []  # what has come of the last document so far
            for b in batches:
                if not b.num_rows:
                    continue
                key = list(zip(b.column("source").to_pylist(), b.column("granularity").to_pylist()))
                begin = next(i for i in range(len(key) - 1, -1, -1) if i == 0 or key[i - 1] != key[-1])
                same = bool(held) and begin == 0 and (held[-1].column("source")[-1].as_py(), held[-1].column("granularity")[-1].as_py()) == key[0]
                if not same and (held or begin):
                    yield from answered(pool, pa.Table.from_batches([*held, b.slice(0, begin)])).to_batches()
                    held = []
                held.append(b.slice(begin))
            if held:
                yield from answered(pool, pa.Table.from_batches(held)).to_batches()

    return chunks.repartition("source", "granularity").sortWithinPartitions("source", "granularity", "chunk_index").mapInArrow(run, chunks.schema)


def data_uri(path: str) -> str:
    """A file as a data URI; its MIME type by its name."""
    mime = mimetypes.guess_type(path)[0] or "image/jpeg"
    return f"data:{mime};base64,{base64.b64encode(Path(path).read_bytes()).decode()}"


def needs_vision(kinds: tuple[str, ...] = ("table", "image"), only_empty: bool = True) -> Column:
    """Chunks of these kinds with an image and, unless told otherwise, without content of their own."""
    own = (F.col("page_content") != "") & ~F.col("page_content").eqNullSafe(F.coalesce("extras.inferred_caption", F.lit("")))
    image = F.col("extras.img_path").isNotNull() | F.col("extras.image_b64").isNotNull()
    return F.col("kind").isin(list(kinds)) & image & (~own if only_empty else F.lit(True))


def add_vision(chunks: DataFrame, model: Callable[[str, str], str], kinds: tuple[str, ...] = ("table", "image"), only_empty: bool = True, refresh: bool = False, workers: int = 5) -> DataFrame:
    """page_content by ``model(prompt, data_uri)`` where needs_vision. An image that isn't embedded is read from its
    path where the chunk is; ``model`` may also be an object with generate_vision().

    Failures, unreadable images among them, leave a chunk as it is. Counts and hashes stay unless ``refresh``."""

    see = getattr(model, "generate_vision", model)

    @F.pandas_udf("string")
    def run(kind: pd.Series, image: pd.Series, path: pd.Series) -> pd.Series:
        def one(k: str, i: object, p: object) -> str | None:
            try:
                if not isinstance(i, str) and isinstance(p, str):
                    i = data_uri(p)
                return (see(VISION_PROMPTS.get(k, VISION_PROMPTS["image"]), i) or "").strip() or None if isinstance(i, str) else None
            except Exception:
                return None

        with ThreadPoolExecutor(workers) as pool:
            return pd.Series(list(pool.map(one, kind, image, path)), dtype=object)

    wanted = needs_vision(kinds, only_empty)
    answer = run("kind", F.when(wanted, F.col("extras.image_b64")), F.when(wanted, F.col("extras.img_path")))
    d = chunks.withColumn("_answer", answer).withColumn("page_content", F.coalesce("_answer", "page_content"))
    if refresh:
        d = d.withColumns({"token_count": tokens.BUILT_IN["quarter"].column(F.col("page_content")), "content_hash": content_hash()})
    return d.select(chunks.columns)
