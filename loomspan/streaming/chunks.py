"""Chunking as content lists arrive. An addition: one file holds one document, so each document is
complete within its micro-batch and any chunker works."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators.blocks import blocks_from_content_list
from loomspan.operators.refine import refine


def content_list_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """(source, content, modified) of JSON files as they appear."""
    d = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", most_files).load(folder)
    return d.select(F.regexp_replace("path", "^file:/*", "/").alias("source"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def chunk_stream(stream: DataFrame, chunker: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends refined chunks of each micro-batch to Parquet, in a folder named by the batch: a batch
    that is repeated after a failure replaces what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        refine(chunker(blocks_from_content_list(df))).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def new_documents(stream: DataFrame, watermark: str = "7 days") -> DataFrame:
    """``stream`` without contents that came before, within the watermark of their time."""
    d = stream.withColumn("content_hash", F.sha2("content", 256)).withWatermark("modified", watermark)
    return d.dropDuplicatesWithinWatermark(["content_hash"])
