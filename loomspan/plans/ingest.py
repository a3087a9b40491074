"""From files to enriched chunks: parse, filter by kind, chunk, refine, format."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.interfaces import Chunker
from loomspan.operators import blocks as B
from loomspan.operators.chunkers import chunker
from loomspan.operators.refine import refine
from loomspan.sinks.chunks import formatted
from loomspan.sources import files


def run(blocks: DataFrame, strategy: str | Chunker = "by_token", output: str = "chunks", tables: bool = True, images: bool = True, equations: bool = True, tokenizer: object = None, image_mode: str = "path", base_dir: str | None = None, captions: bool = True, image_files: DataFrame | None = None, where: object = None, **options: object) -> DataFrame:
    """Blocks -> formatted chunks. ``where`` restricts blocks, by source for example, before the
    folds, through which no filter passes; ``options`` are the chunker's."""
    if where is not None:
        blocks = blocks.filter(where)
    if tokenizer is not None and isinstance(strategy, str) and strategy not in ("by_block", "by_page", "by_section", "fixed_size", "by_semantic", "semantic"):
        options["tokenizer"] = tokenizer
    chunks = chunker(strategy, **options)(B.keep_kinds(blocks, tables, images, equations))
    return formatted(refine(chunks, tokenizer if tokenizer is not None else "quarter", image_mode=image_mode, base_dir=base_dir, captions=captions, images=image_files), output)


def parsed(spark: SparkSession, docs: DataFrame, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fetched documents -> blocks, each by its route. ``parse`` turns (source, path) of documents
    that need a parser into (source, content) with a content list. Others are an error."""
    d = docs.withColumn("_route", files.route(F.col("path"), F.col("mime_type")))
    wrong = ["missing", "unsupported", *(["parse"] if parse is None else [])]
    for r in d.filter(F.col("_route").isin(wrong)).select("source", "_route").limit(1).collect():
        raise ValueError(f"{r['source']}: {r['_route']}")
    of = lambda k: d.filter(F.col("_route") == k)
    blocks = B.blocks_from_text(files.read_rows(of("text")))
    blocks = blocks.unionByName(B.blocks_from_content_list(files.read_rows(of("json")), content="value"))
    if parse is not None:
        blocks = blocks.unionByName(B.blocks_from_content_list(parse(of("parse").select("source", "path"))))
    return blocks


def ingest(spark: SparkSession, path: str, strategy: str = "by_token", parse: Callable[[DataFrame], DataFrame] | None = None, **options: object) -> DataFrame:
    """A file, a folder of files, or a parser's output folder -> chunks. A URI that ends in '/' is a folder."""
    if files.is_uri(path):
        docs = files.fetch(spark, folder=path) if path.endswith("/") else files.fetch(spark, path=path)
        return run(parsed(spark, docs, parse), strategy, **options)
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if p.is_dir() and any(p.glob("*_content_list.json")):
        return ingest_from_output(spark, path, strategy, **options)
    docs = files.fetch(spark, folder=path) if p.is_dir() else files.fetch(spark, path=path)
    return run(parsed(spark, docs, parse), strategy, **options)


def ingest_from_output(spark: SparkSession, folder: str, strategy: str = "by_token", **options: object) -> DataFrame:
    """A parser's output folder -> chunks; images lie in the folder."""
    name = files.content_list_of(folder)
    d = files.read_texts(spark, name).select(F.lit(str(Path(folder).resolve())).alias("source"), F.col("value").alias("content"))
    return run(B.blocks_from_content_list(d), strategy, **{"base_dir": str(Path(folder).resolve()), **options})


def ingest_from_json(spark: SparkSession, path: str, strategy: str = "by_token", **options: object) -> DataFrame:
    """A content list in JSON -> chunks; the source is the file's path."""
    d = files.read_texts(spark, path).withColumnRenamed("value", "content")
    return run(B.blocks_from_content_list(d), strategy, **{"base_dir": str(Path(path).resolve().parent), **options})
