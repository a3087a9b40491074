"""Adapters that give the driver's tables the shape of parsed documents, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.schema import BLOCK


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a block; its kind follows from its place."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    r = F.col("pos") % 16
    kind = F.when(r == 0, "title").when(r == 5, "table").when(r == 8, "image").when(r == 11, "list").when(r == 13, "equation").when(r == 15, "discarded").otherwise("text")
    none = F.array().cast("array<string>")
    out = lines.select(
        F.concat(F.lit("doc:"), "doc_id").alias("source"),
        kind.alias("kind"),
        F.when(r.isin(5, 8), "").otherwise(F.col("line")).alias("text"),
        F.floor(F.col("pos") / 20).cast("int").alias("page_idx"),
        F.array(F.lit(50), (F.col("pos") % 20) * 50, F.lit(950), (F.col("pos") % 20) * 50 + 45).alias("bbox"),
        F.when(r == 0, 1 + F.floor(F.col("pos") / 16) % 3).otherwise(0).cast("int").alias("title_level"),
        F.when(r == 5, F.concat(F.lit("<table><tr><td>"), "line", F.lit("</td></tr></table>"))).otherwise("").alias("html"),
        F.when(r == 8, F.concat(F.lit("images/"), "doc_id", F.lit("_"), "pos", F.lit(".jpg"))).otherwise("").alias("img_path"),
        F.when(F.col("pos") % 32 == 8, F.array("line")).otherwise(none).alias("captions"),
        none.alias("footnotes"),
        F.col("pos").alias("block_index"),
        F.col("pos").alias("reading_order"),
        F.lit("{}").alias("raw"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in BLOCK])


#: The same blocks in DuckDB, as the head of a WITH list.
BLOCKS_SQL = """
WITH fx_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
blocks AS (
  SELECT 'doc:' || doc_id AS source,
    CASE pos % 16 WHEN 0 THEN 'title' WHEN 5 THEN 'table' WHEN 8 THEN 'image' WHEN 11 THEN 'list' WHEN 13 THEN 'equation' WHEN 15 THEN 'discarded' ELSE 'text' END AS kind,
    CASE WHEN pos % 16 IN (5, 8) THEN '' ELSE line END AS text,
    (pos // 20)::INTEGER AS page_idx,
    [50, (pos % 20) * 50, 950, (pos % 20) * 50 + 45] AS bbox,
    CASE WHEN pos % 16 = 0 THEN 1 + (pos // 16) % 3 ELSE 0 END::INTEGER AS title_level,
    CASE WHEN pos % 16 = 5 THEN '<table><tr><td>' || line || '</td></tr></table>' ELSE '' END AS html,
    CASE WHEN pos % 16 = 8 THEN 'images/' || doc_id || '_' || pos || '.jpg' ELSE '' END AS img_path,
    CASE WHEN pos % 32 = 8 THEN [line] ELSE []::VARCHAR[] END AS captions,
    []::VARCHAR[] AS footnotes,
    pos::INTEGER AS block_index, pos::INTEGER AS reading_order
  FROM fx_lines)"""


def content_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, content): the blocks of a document as a parser's content list in JSON."""
    b = blocks(spark, sf_dir)
    item = F.struct(
        F.col("reading_order"),
        F.when(F.col("kind") == "title", "text").otherwise(F.col("kind")).alias("type"),
        F.when(~F.col("kind").isin("list", "table", "image"), F.col("text")).alias("text"),
        F.when(F.col("kind") == "title", F.col("title_level")).alias("text_level"),
        "bbox",
        "page_idx",
        F.when(F.col("kind") == "list", F.array("text")).alias("list_items"),
        F.when(F.col("kind") == "table", F.col("html")).alias("table_body"),
        F.when(F.col("kind") == "image", F.col("img_path")).alias("img_path"),
        F.when(F.col("kind") == "image", F.col("captions")).alias("image_caption"),
    )
    return b.groupBy("source").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, vec_id, vec): embeddings in runs of 50, each row in a sentence's place."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 50).alias("run_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


VECTORS_SQL = "WITH vectors AS (SELECT vec_id // 50 AS run_id, vec_id, embedding::DOUBLE[] AS vec FROM embeddings)"
