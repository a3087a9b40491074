"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.lineage import drop, written  # noqa: F401

#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Java's spelling of the same.
JAVA_WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """What runs inside sends ``rows`` rows at a time to Python: long texts make large batches, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def row_key(*columns: Column | str) -> list[Column]:
    """r1, r2: 128 bits that name a row's values of the columns."""
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(7), *reversed(columns)).alias("r2")]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row: a lambda variable holds it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; no word for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({JAVA_WORD})"), F.lit(1))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column ``_row`` beside the given columns.

    What an operator adds can't clash with columns that it only carries along: ``_row.*`` gives
    them back as they were."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(k) for k, c in columns.items()])


def joined_if_small(left: DataFrame, right: DataFrame, on: list[str], how: str, most_rows: int) -> DataFrame:
    """Join with ``right`` broadcast if it has at most ``most_rows`` rows (counted here, so ``right``
    should be cheap to count, such as a written table), else by shuffle."""
    if right.limit(most_rows + 1).count() <= most_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)
