"""Chunks' boxes drawn on pages: a PDF for each source, outlines coloured by kind."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sinks.chunks import pdf_rects

#: Red, green and blue of a kind's outlines.
COLOURS = {"title": (0.85, 0.1, 0.1), "text": (0.1, 0.35, 0.85), "list": (0.1, 0.6, 0.6), "table": (0.1, 0.6, 0.2), "image": (0.9, 0.5, 0.0), "equation": (0.55, 0.2, 0.75), "discarded": (0.5, 0.5, 0.5)}


def page_drawings(chunks: DataFrame, width: float, height: float, rotation: int = 0, normalized: bool = True) -> DataFrame:
    """(source, page, content): a page's boxes as PDF drawing operators, each labelled with its chunk's number."""
    rects = pdf_rects(chunks, width, height, rotation, normalized).join(chunks.select("source", "chunk_index", "kind"), ["source", "chunk_index"])
    colour = F.create_map(*[x for k, v in COLOURS.items() for x in (F.lit(k), F.lit(" ".join(f"{c:g}" for c in v)))])
    rgb = F.coalesce(F.element_at(colour, F.col("kind")), F.lit("0 0 0"))
    line = F.concat(rgb, F.lit(" RG "), rgb, F.lit(" rg "), F.format_string("%.2f %.2f %.2f %.2f re S BT /F1 7 Tf %.2f %.2f Td (%d) Tj ET", "x", "y", "w", "h", F.col("x") + 1, F.col("y") + F.col("h") - 7, F.col("chunk_index")))
    g = rects.select("source", "page", F.struct("chunk_index", "y", "x", line.alias("line")).alias("r")).groupBy("source", "page").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return g.select("source", "page", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("content"))


def pdf_bytes(pages: list[str], width: float, height: float) -> bytes:
    """A PDF of pages with the given drawing operators."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for content in pages:
        data = content.encode("latin-1", "replace")
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (width, height, len(objects) + 2))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, x in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, x)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def write_pdfs(chunks: DataFrame, folder: str, width: float = 595.0, height: float = 842.0, normalized: bool = True) -> DataFrame:
    """(source, path, n_pages): a PDF in the shared folder for each source, named by its hash; pages without boxes are blank."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["source"]):
            found = {r["page"]: r["content"] for r in rows}
            pages = [found.get(i, "") for i in range(max(found) + 1)]
            path = os.path.join(folder, hashlib.sha256((source or "").encode()).hexdigest()[:16] + ".pdf")
            with open(path, "wb") as f:
                f.write(pdf_bytes(pages, width, height))
            yield pa.RecordBatch.from_pylist([{"source": source, "path": path, "n_pages": len(pages)}], pa.schema([("source", pa.string()), ("path", pa.string()), ("n_pages", pa.int64())]))

    d = page_drawings(chunks, width, height, normalized=normalized)
    return d.repartition("source").sortWithinPartitions("source", "page").mapInArrow(run, "source string, path string, n_pages long")
