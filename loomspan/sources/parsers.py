"""Adapters of layout parsers: (source, path) of documents to (source, content), for ``ingest(..., parse=)``.

The parsers run on the executors, a file at a time, and must be installed there.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.operators import blocks as B
from loomspan.interfaces import Parser
from loomspan.sources.files import content_list_of


def by_file(docs: DataFrame, parse: Callable[[str], str]) -> DataFrame:
    """(source, content): ``parse`` gives a path's content in JSON. One file a task, since a file takes long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([parse(p) for p in b.column("path").to_pylist()], pa.string())], ["source", "content"])

    return docs.select("source", "path").mapInArrow(run, "source string, content string")


class ContentListParser(Parser):
    """A command that writes ``*_content_list.json`` somewhere below an output folder: ``run(out, name, data)``.

    Where it puts the list differs by backend and by its cutting of long names, so the folder is new for each
    file and searched. By default ``run`` is the parsing function of the package ``mineru``.
    """

    def __init__(self, run: Callable[[str, str, bytes], None] | None = None, backend: str = "pipeline", output: str | None = None):
        self.run, self.backend, self.output = run, backend, output

    def content(self, path: str) -> str:
        run = self.run or self._installed()
        if self.output:
            os.makedirs(self.output, exist_ok=True)
        out = tempfile.mkdtemp(prefix=Path(path).stem[:40] + "-", dir=self.output)
        run(out, Path(path).name, Path(path).read_bytes())
        found = sorted(str(p.parent) for p in Path(out).rglob("*_content_list.json"))
        if not found:
            raise FileNotFoundError(f"the parser left no *_content_list.json for {path}")
        return Path(content_list_of(found[0])).read_text(encoding="utf-8")

    def _installed(self) -> Callable[[str, str, bytes], None]:
        try:
            from mineru.cli.common import do_parse
        except ImportError as e:
            raise ImportError("the package mineru isn't installed; parse beforehand and give the output folder to ingest_from_output") from e
        return lambda out, name, data: do_parse(out, pdf_file_names=[name], pdf_bytes_list=[data], p_lang_list=[""], backend=self.backend)

    def __call__(self, docs: DataFrame) -> DataFrame:
        return by_file(docs, self.content)

    def process(self, docs: DataFrame) -> DataFrame:
        return B.blocks_from_content_list(self(docs))


def layout_items(document: object) -> list[dict]:
    """A converted document's items, in reading order, as blocks_from_layout_items takes them."""
    out = []
    for item, level in document.iterate_items():
        prov = [{"page_no": p.page_no, "l": p.bbox.l, "t": p.bbox.t, "r": p.bbox.r, "b": p.bbox.b, "origin": str(p.bbox.coord_origin)} for p in getattr(item, "prov", None) or []]
        page = document.pages.get(prov[0]["page_no"]) if prov else None
        label = str(getattr(item.label, "value", item.label))
        captions = getattr(item, "caption_text", None)
        caption = captions(document) if callable(captions) else ""
        html = item.export_to_html(document) if label == "table" and hasattr(item, "export_to_html") else None
        out.append({"label": label, "text": getattr(item, "text", "") or "", "level": getattr(item, "level", level), "html": html, "captions": [caption] if caption else [], "prov": prov, "page_w": page.size.width if page else None, "page_h": page.size.height if page else None})
    return out


class LayoutParser(Parser):
    """``convert(path)`` gives a document with iterate_items() and pages; by default that of the package ``docling``."""

    def __init__(self, convert: Callable[[str], object] | None = None):
        self.convert = convert

    def content(self, path: str) -> str:
        convert = self.convert
        if convert is None:
            try:
                from docling.document_converter import DocumentConverter
            except ImportError as e:
                raise ImportError("the package docling isn't installed") from e
            convert = lambda p: DocumentConverter().convert(p).document
        return json.dumps(layout_items(convert(path)))

    def __call__(self, docs: DataFrame) -> DataFrame:
        return by_file(docs, self.content)

    def process(self, docs: DataFrame) -> DataFrame:
        return B.blocks_from_layout_items(self(docs))
