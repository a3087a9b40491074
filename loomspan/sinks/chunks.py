"""Writing chunks, and the records that other frameworks take."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate, islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.lineage import located, shared_folder
from loomspan.schema import CHUNK, CHUNK_FIELDS, EXTRAS

ALL_FIELDS = {"ignoreNullFields": "false"}


def merged_json(first: Column, second: Column) -> Column:
    """Two JSON objects as one: the second's keys after the first's."""
    both = F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(","), F.substring(second, F.lit(2), F.length(second)))
    return F.when(second == "{}", first).when(first == "{}", second).otherwise(both)


def extras_json() -> Column:
    """Extras as a JSON object without absent keys; custom keys lie beside the others."""
    known = F.coalesce(F.to_json(F.struct(*[f"extras.{f.name}" for f in EXTRAS if f.name != "custom"])), F.lit("{}"))
    return merged_json(known, F.coalesce(F.to_json("extras.custom"), F.lit("{}")))


def json_line() -> Column:
    """One chunk as a JSON object in the order of its fields; nulls are kept but for extras' keys."""
    parts: list[Column] = []
    for i, name in enumerate(CHUNK_FIELDS):
        head = F.lit(f'{", " if i else "{"}"{name}": ')
        value = extras_json() if name == "extras" else F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v")), ALL_FIELDS), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null"))
        parts += [head, value]
    return F.concat(*parts, F.lit("}"))


def write_jsonl(chunks: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """One object a line; many part files in parallel, or one file in the order of source and index."""
    lines = chunks.select("source", "granularity", "chunk_index", json_line().alias("value"))
    if single_file:
        lines = lines.orderBy("source", "chunk_index").coalesce(1)
    lines.select("value").write.mode(mode).text(path)


def write_json_array(chunks: DataFrame, path: str, indent: int = 4) -> None:
    """One local file with a JSON array, in the order of source and index.

    Elements are made on the executors, as parts in the shared folder; the driver appends the parts' bytes, one
    after the other, and removes each."""
    pad = " " * indent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                texts = [json.dumps(json.loads(x), ensure_ascii=False, indent=indent) for x in b.column(0).slice(k, 1000).to_pylist()]
                out = ["\n".join(pad + line for line in t.split("\n")) + "," for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    jvm, parts = chunks.sparkSession.sparkContext._jvm, f"{shared_folder(chunks.sparkSession)}/array-{uuid.uuid4().hex}"
    fs, at = located(chunks, parts)
    try:
        chunks.orderBy("source", "chunk_index").select(json_line().alias("value")).mapInArrow(run, "value string").write.text(parts)
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")]
        with Path(path).open("wb") as f:
            f.write(b"[\n")
        out = jvm.java.io.FileOutputStream(str(Path(path).absolute()), True)
        try:
            for p in sorted(found, key=lambda p: (int(p.getName().split("-")[1]), p.getName())):
                part = fs.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
                fs.delete(p, False)
        finally:
            out.close()
    finally:
        fs.delete(at, True)
    with Path(path).open("r+b") as f:
        size = f.seek(0, 2)
        f.truncate(size - (2 if size > 2 else 1))  # the last comma and line break, or that of "["
        f.seek(0, 2)
        f.write(b"\n]\n" if size > 2 else b"]\n")


#: Bytes of an array's file that a task reads, besides the rest of its last element.
RANGE = 16 << 20


def _bodies(path: str, mark: bytes, begin: int, end: int) -> Iterator[bytes]:
    """What follows each mark that begins in [begin, end), up to the next mark."""
    with open(path, "rb") as f:
        f.seek(begin)
        *whole, last = f.read(end - begin + len(mark) - 1).split(mark)
        if not whole:
            return
        yield from whole[1:]
        rest = bytearray(last)
        while (found := rest.find(mark, max(0, len(rest) - (1 << 20) - len(mark)))) < 0 and (more := f.read(1 << 20)):
            rest += more
        yield bytes(rest if found < 0 else rest[:found])


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a file that write_json_array made, with their place in the array.

    The file, which all executors reach, is read in ranges of bytes: an element begins at a line that is no more
    than the indent and a brace, which no line inside of an element is. A first pass counts each range's elements."""
    with open(path, "rb") as f:
        head = f.read(1024)
    if not (begins := re.match(rb"\[(\n *\{\n)", head)) and head != b"[]\n":
        raise ValueError(f"{path} isn't an array as write_json_array writes it")
    mark, step, size = begins[1] if begins else b"\n{\n", RANGE, os.path.getsize(path)
    n = -(-size // step)
    ranges = spark.range(0, n, 1, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            with open(path, "rb") as f:
                f.seek(i * step)
                k = f.read(step + len(mark) - 1).count(mark)
            yield pa.RecordBatch.from_pydict({"id": [i], "n": [k]})

    firsts = list(accumulate((r["n"] for r in sorted(ranges.mapInArrow(count, "id long, n long").collect())), initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            bodies, place = _bodies(path, mark, i * step, (i + 1) * step), firsts[i]
            while some := [(b"{" + x[: x.rindex(b"}") + 1]).decode() for x in islice(bodies, 1000)]:
                yield pa.RecordBatch.from_arrays([pa.array(range(place, place + len(some)), pa.int64()), pa.array(some, pa.string())], ["place", "value"])
                place += len(some)

    return ranges.mapInArrow(run, "place long, value string").select("place", F.from_json("value", CHUNK).alias("c")).select("place", "c.*")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; fields that are missing are empty."""
    d = spark.read.schema(CHUNK).json(path)
    return d.fillna("", ["granularity", "doc_summary", "chunk_context", "content_hash"]).fillna(0, ["token_count"])


def records(chunks: DataFrame) -> DataFrame:
    """Chunks as plain dicts, one JSON object each."""
    return chunks.select(json_line().alias("value"))


def langchain(chunks: DataFrame) -> DataFrame:
    """(page_content, metadata): metadata is a JSON object; keys in extras come last and win."""
    base = F.to_json(F.struct("source", "kind", "title_path", "title_level", "chunk_index", "token_count", "content_hash", "position_int"), ALL_FIELDS)
    return chunks.select("page_content", merged_json(base, extras_json()).alias("metadata"))


def llamaindex(chunks: DataFrame) -> DataFrame:
    """(text, metadata): as langchain, without positions."""
    base = F.to_json(F.struct("source", "kind", "title_path", "title_level", "chunk_index", "token_count", "content_hash"), ALL_FIELDS)
    return chunks.select(F.col("page_content").alias("text"), merged_json(base, extras_json()).alias("metadata"))


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"chunks": lambda c: c, "dicts": records, "langchain": langchain, "llamaindex": llamaindex}


def formatted(chunks: DataFrame, output: str) -> DataFrame:
    if output not in FORMATS:
        raise ValueError(f"unknown output {output!r}; there are {', '.join(FORMATS)}")
    return FORMATS[output](chunks)


def page_boxes(chunks: DataFrame) -> DataFrame:
    """(source, page, boxes): every page's boxes, each with its chunk's index and kind."""
    d = chunks.select("source", "chunk_index", "kind", F.explode("position_int").alias("p"))
    d = d.select("source", F.get("p", F.lit(0)).alias("page"), F.struct("chunk_index", "kind", F.slice("p", 2, 4).alias("bbox")).alias("box"))
    return d.groupBy("source", "page").agg(F.array_sort(F.collect_list("box")).alias("boxes"))


def is_normalized(chunks: DataFrame) -> DataFrame:
    """(source, normalized): whether all coordinates of a source lie in thousandths of the page."""
    most = F.array_max(F.transform("position_int", lambda p: F.array_max(F.slice(p, 2, 4))))
    return chunks.groupBy("source").agg((F.coalesce(F.max(most), F.lit(0)) <= 1001).alias("normalized"))


def pdf_rects(chunks: DataFrame, width: float, height: float, rotation: int = 0, normalized: bool = True) -> DataFrame:
    """(source, chunk_index, page, x, y, w, h): boxes in points from the bottom left, turned with
    the page; boxes narrower or lower than a point are left out."""
    d = chunks.select("source", "chunk_index", F.explode("position_int").alias("p"))
    sx, sy = (width / 1000, height / 1000) if normalized else (1.0, 1.0)
    at = lambda i, scale: F.get("p", F.lit(i)) * F.lit(scale)
    d = d.select("source", "chunk_index", F.get("p", F.lit(0)).alias("page"), at(1, sx).alias("x0"), at(3, sx).alias("x1"), (F.lit(height) - at(4, sy)).alias("low"), (F.lit(height) - at(2, sy)).alias("high"))
    d = d.withColumns({"rw": F.abs(F.col("x1") - F.col("x0")), "rh": F.abs(F.col("high") - F.col("low"))}).filter("rw >= 1 and rh >= 1")
    turned = {
        0: ("x0", "low", "rw", "rh"),
        90: ("low", "x0", "rh", "rw"),
        180: (F.lit(width) - F.col("x1"), "low", "rw", "rh"),
        270: (F.lit(height) - F.col("high"), F.lit(width) - F.col("x1"), "rh", "rw"),
    }[rotation % 360]
    return d.select("source", "chunk_index", "page", *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in zip(turned, ("x", "y", "w", "h"))])
