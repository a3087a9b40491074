"""Cells: documents spread by hash into groups of a few MB, worked on as arrays.

Per-word or per-anchor facts of a cell travel as sorted binary arrays, one row for each pair of
cell and hash range, instead of a row each: that is what keeps shuffles near the size of the
input. A hot key is in one entry per cell at most, however often the cell holds it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that make a cell.
CELL_BYTES = 14 << 20


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers are kept between tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def cell_count(docs: DataFrame, each: int = CELL_BYTES) -> int:
    """As many cells as the texts' bytes, counted, make up."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(1, -(-size // each))


def with_cell(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with ``cell``: from id and text, so equal ids don't gather in one cell."""
    return docs.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


def ranges(sorted_hashes: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of the ``n`` equal ranges of 64-bit hashes that aren't empty."""
    edges = [int(i * (1 << 64) // n) for i in range(1, n)]
    at = [0, *np.searchsorted(sorted_hashes, np.array(edges, np.uint64)).tolist(), len(sorted_hashes)]
    for i in range(n):
        if at[i] < at[i + 1]:
            yield i, at[i], at[i + 1]
