"""Enumerating and reading files."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspan.functions.strings import extension
from loomspan.lineage import written
from loomspan.schema import FETCHED

OFFICE = {f".{k}": f"application/vnd.openxmlformats-officedocument.{v}" for k, v in (("docx", "wordprocessingml.document"), ("pptx", "presentationml.presentation"), ("xlsx", "spreadsheetml.sheet"))}
PARSEABLE = ("application/pdf", *OFFICE.values(), *(f"image/{k}" for k in ("png", "jpeg", "jpg", "tiff", "bmp", "webp")))
UNKNOWN_MIME = "application/octet-stream"


def mime_type(path: Column) -> Column:
    """By extension, from the standard library's table, as a literal map: no join, no Python."""
    table = F.create_map(*[F.lit(v) for kv in sorted((mimetypes.types_map | OFFICE).items()) for v in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit(UNKNOWN_MIME))


def walk(folder: str, extensions: list[str] | None, recursive: bool) -> Iterator[str]:
    """Files of a folder by name, then those of its folders; links to folders aren't followed.

    Names that begin with '_' or '.', which Spark's own listing skips, are files like others."""
    want = {e.lower() if e.startswith(".") else "." + e.lower() for e in extensions} if extensions else None
    for at, dirs, names in os.walk(folder, followlinks=False):
        dirs.sort()
        for name in sorted(names):
            if want is None or os.path.splitext(name)[1].lower() in want:
                yield os.path.join(at, name)
        if not recursive:
            break


def is_uri(path: str) -> bool:
    return "://" in path


def below_uri(uri: str, recursive: bool) -> list:
    """Files and folders below a URI of a file system that pyarrow knows (file, s3, gs, hdfs)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.get_file_info(fs.FileSelector(path, recursive=recursive))


class FolderSource(DataSource):
    """``format("loomspan_files")``: one row a file (source, path, mime_type, size), of a shared folder or a URI.

    Options: path, recursive (true), extensions (comma-separated). Each folder below the first
    is a partition of its own."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_files"

    def schema(self) -> str:
        return "source string, path string, mime_type string, size long"

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(self.options)


class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        super().__init__(path)
        self.recursive = recursive


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"] if is_uri(options["path"]) else os.path.realpath(options["path"])
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.extensions = [e.strip() for e in options.get("extensions", "").split(",") if e.strip()] or None

    def partitions(self) -> list[Folder]:
        if is_uri(self.path):
            found = sorted(x.path for x in below_uri(self.path, False) if not x.is_file) if self.recursive else []
            scheme = self.path.split("://", 1)[0]
            return [Folder(self.path, False), *(Folder(f"{scheme}://{d}", True) for d in found)]
        below = sorted(d.path for d in os.scandir(self.path) if d.is_dir(follow_symlinks=False)) if self.recursive else []
        return [Folder(self.path, False), *(Folder(d, True) for d in below)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if is_uri(partition.value):
            scheme, want = partition.value.split("://", 1)[0], {e.lower() if e.startswith(".") else "." + e.lower() for e in self.extensions or []}
            for x in sorted(below_uri(partition.value, partition.recursive), key=lambda x: x.path):
                if x.is_file and (not want or os.path.splitext(x.path)[1].lower() in want):
                    name = f"{scheme}://{x.path}"
                    yield (name, name, mimetypes.guess_type(x.path)[0] or UNKNOWN_MIME, x.size)
            return
        for f in walk(partition.value, self.extensions, partition.recursive):
            yield (f, f, mimetypes.guess_type(f)[0] or UNKNOWN_MIME, os.path.getsize(f))


def fetch(spark: SparkSession, path: str | None = None, folder: str | None = None, extensions: list[str] | None = None, recursive: bool = True, metadata: dict[str, str] | None = None) -> DataFrame:
    """Fetched documents of one file or of a folder; exactly one of both must be given."""
    if (path is None) == (folder is None):
        raise ValueError("give either a path or a folder")
    spark.dataSource.register(FolderSource)
    if path is not None and is_uri(path):
        d = spark.createDataFrame([(path, path, mimetypes.guess_type(path)[0] or UNKNOWN_MIME)], "source string, path string, mime_type string")
    elif path is not None:
        p = Path(path)
        if not p.exists():
            raise FileNotFoundError(path)
        if not p.is_file():
            raise ValueError(f"{path} is not a file")
        name = str(p.resolve())
        d = spark.createDataFrame([(name, name, mimetypes.guess_type(name)[0] or UNKNOWN_MIME)], "source string, path string, mime_type string")
    else:
        if not is_uri(folder) and not Path(folder).is_dir():
            raise FileNotFoundError(folder)
        d = spark.read.format("loomspan_files").option("path", folder).option("recursive", str(recursive).lower()).option("extensions", ",".join(extensions or [])).load()
    meta = F.create_map(*[F.lit(v) for kv in (metadata or {}).items() for v in kv]) if metadata else F.create_map().cast("map<string,string>")
    return d.select("source", "path", "mime_type", meta.alias("metadata")).select([F.col(f.name).cast(f.dataType) for f in FETCHED])


def fetch_named(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The file of this name that lies in the folder itself."""
    if not (Path(folder) / name).is_file():
        raise FileNotFoundError(f"{folder}/{name}")
    return fetch(spark, path=str(Path(folder) / name))


def route(path: Column, mime: Column) -> Column:
    """How a document is read: json, text, parse, missing or unsupported."""
    ext = extension(path)
    return F.when(path.isNull(), "missing").when(ext == ".json", "json").when(ext == ".txt", "text").when(mime.isin(list(PARSEABLE)), "parse").otherwise("unsupported")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, value): whole text files; bytes that aren't UTF-8 become replacement characters."""
    d = spark.read.format("binaryFile").load(paths)
    return d.select(F.regexp_replace("path", "^file:/*", "/").alias("source"), F.decode("content", "UTF-8").alias("value"))


def read_rows(docs: DataFrame) -> DataFrame:
    """(source, path) -> (source, value): text files read where the rows are, so paths don't pass the
    driver. A path is one of a shared folder, or a URI that pyarrow's file systems know."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                if "://" in path:
                    system, at = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(at) as f:
                        out.append(f.read())
                else:
                    out.append(Path(path).read_bytes())
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], ["source", "value"])

    return docs.select("source", "path").mapInArrow(run, "source string, value string")


def content_list_of(folder: str) -> str:
    """The content list in a parser's output folder; the first by name if there are several."""
    found = sorted(str(p) for p in Path(folder).glob("*_content_list.json"))
    if not found:
        raise FileNotFoundError(f"no *_content_list.json in {folder}")
    return found[0]


def download(spark: SparkSession, urls: list[str], get: Callable[[str], bytes], folder: str, suffix: str = "html") -> DataFrame:
    """Fetches URLs by ``get`` on the executors and stores them in a shared folder; failures are left out.

    Names come from the URL, its query included, so different URLs don't overwrite each other."""
    from loomspan.functions.strings import web_file_name

    def run(rows: Iterator) -> Iterator:
        import pandas as pd

        for pdf in rows:
            out = []
            for url, name in zip(pdf["url"], pdf["name"]):
                try:
                    data = get(url)
                except Exception:
                    continue
                path = os.path.join(folder, name)
                Path(path).write_bytes(data)
                out.append((url, path))
            yield pd.DataFrame(out, columns=["source", "path"])

    d = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, min(len(urls), 64)))
    d = d.withColumn("name", web_file_name(F.col("url"), suffix)).mapInPandas(run, "source string, path string")
    return d.select("source", "path", mime_type(F.col("path")).alias("mime_type"), F.create_map().cast("map<string,string>").alias("metadata"))


def listed_files(listing: DataFrame, most_levels: int = 1000) -> DataFrame:
    """(id, parent_id, name, is_folder) -> files with their folder path and a name that's their own.

    The tree is walked level by level by joins; a level is written once. A listing that is deeper than
    ``most_levels`` holds a circle and is an error. Of files with one name all but the first by id
    take '{base}_{id}{ext}'."""
    from pyspark.sql.window import Window

    level = listing.filter("parent_id is null").select("id", "name", "is_folder", F.lit("").alias("folder"))
    every = level
    for _ in range(most_levels):
        inside = level.filter("is_folder").select(F.col("id").alias("parent_id"), F.concat("folder", F.lit("/"), "name").alias("folder"))
        level = written(listing.join(inside, "parent_id").select("id", "name", "is_folder", "folder"), "listing")
        if not level.limit(1).count():
            break
        every = every.unionByName(level)
    else:
        raise ValueError(f"the listing is deeper than {most_levels} levels")
    ext = F.regexp_extract("name", r"^.+(\.[^.]*)$", 1)
    base = F.substring("name", F.lit(1), F.length("name") - F.length(ext))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    return every.filter("not is_folder").select("id", "folder", "name", F.when(nth == 1, F.col("name")).otherwise(F.concat(base, F.lit("_"), F.col("id").cast("string"), ext)).alias("local_name"))
