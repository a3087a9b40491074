"""Cutting lineage by tables written into a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor reaches: the one that the session's ``spark.checkpoint.dir`` names.

    Where that is unset, a local master gets a temporary folder; on a cluster it is an error, since
    tables in a folder of one machine would be lost with it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def located(df: DataFrame, path: str):
    """The path's file system, and the path as that takes it."""
    jvm = df.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` into the shared folder and read it back.

    The files outlive lost executors. ``drop`` removes them, or Spark's file system when the JVM ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = located(df, path)
    fs.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more: all that was made from them is written."""
    for t in tables:
        fs, at = located(t, t._written_to)
        fs.delete(at, True)
