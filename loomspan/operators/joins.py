"""Joins that chunks lend themselves to; all are equi-joins within a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_blocks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, chunk_index, block_index, kind): the blocks that each chunk came from."""
    refs = chunks.select("source", "chunk_index", F.explode("block_indices").alias("block_index"))
    return refs.join(blocks.select("source", "block_index", F.col("kind").alias("block_kind")), ["source", "block_index"]).select("source", "chunk_index", "block_index", "block_kind")


def parents(chunks: DataFrame) -> DataFrame:
    """(source, chunk_index, granularity, parent_index, parent_granularity)."""
    child = chunks.select("source", "chunk_index", "granularity", F.col("extras.parent_chunk_index").alias("parent_index")).filter("parent_index is not null")
    parent = chunks.select("source", F.col("chunk_index").alias("parent_index"), F.col("granularity").alias("parent_granularity"))
    return child.join(parent, ["source", "parent_index"]).select("source", "chunk_index", "granularity", "parent_index", "parent_granularity")


def neighbors(chunks: DataFrame) -> DataFrame:
    """(source, chunk_index, next_chunk_index, back): each link and what leads back from its end."""
    c = chunks.select("source", "chunk_index", "next_chunk_index")
    n = chunks.select("source", F.col("chunk_index").alias("next_chunk_index"), F.col("prev_chunk_index").alias("back"))
    return c.join(n, ["source", "next_chunk_index"]).select("source", "chunk_index", "next_chunk_index", "back")


def kind_report(chunks: DataFrame) -> DataFrame:
    """Per granularity and kind: how many chunks, and their least, greatest and mean tokens."""
    return chunks.groupBy("granularity", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.avg("token_count").alias("mean"))
