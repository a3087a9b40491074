"""From parser output and plain text to typed, ordered blocks. All of it is projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.strings import filled, not_blank, strip
from loomspan.schema import BLOCK

CONTENT_LIST = (
    "array<struct<type string, sub_type string, text string, text_level int, bbox array<int>, page_idx int, "
    "list_items array<string>, code_body string, html string, table_body string, img_path string, "
    "image_caption array<string>, table_caption array<string>, code_caption array<string>, "
    "image_footnote array<string>, table_footnote array<string>, code_footnote array<string>>>"
)
LAYOUT_LIST = "array<struct<label string, text string, page_idx int, bbox array<int>, title_level int, html string, img_path string, captions array<string>, footnotes array<string>>>"
LAYOUT_ITEMS = (
    "array<struct<label string, text string, level int, html string, img_path string, captions array<string>, footnotes array<string>, "
    "prov array<struct<page_no int, l double, t double, r double, b double, origin string>>, page_w double, page_h double>>"
)
#: Layout labels that aren't running text.
LABEL_KINDS = {
    "title": "title", "section_header": "title", "table": "table", "picture": "image", "figure": "image", "formula": "equation", "equation": "equation",
    "page_header": "discarded", "page_footer": "discarded", "watermark": "discarded",
}
_NONE = "array<string>"


def _or(*values: Column) -> Column:
    """The first value that isn't null or empty, of strings."""
    return F.coalesce(*[filled(v) for v in values], F.lit(""))


def _or_list(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in values], F.array().cast(_NONE))


def _as_blocks(df: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) for f in BLOCK])


def blocks_from_text(df: DataFrame, source: str = "source", text: str = "value") -> DataFrame:
    """(source, text) -> blocks: the non-blank parts between blank lines, stripped, numbered after
    the blank ones are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n"), strip), lambda p: p != "")
    none = F.array().cast(_NONE)
    out = df.select(F.col(source).alias("source"), F.posexplode(parts).alias("pos", "text"))
    return _as_blocks(out.withColumns({"kind": F.lit("text"), "page_idx": F.lit(0), "bbox": F.array(*map(F.lit, (0, 0, 1000, 1000))), "title_level": F.lit(0), "html": F.lit(""), "img_path": F.lit(""), "captions": none, "footnotes": none, "block_index": F.col("pos"), "reading_order": F.col("pos"), "raw": F.lit("{}")}))


def item_text(x: Column) -> Column:
    """A content-list item's text: its list items, else the first of text, code, table and html that isn't blank."""
    items = F.filter(F.transform(x["list_items"], strip), lambda p: p != "")
    return F.when(F.size(x["list_items"]) > 0, F.array_join(items, "\n")).otherwise(F.coalesce(*[not_blank(x[c]) for c in ("text", "code_body", "table_body", "html")], F.lit("")))


def blocks_from_content_list(df: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """(source, JSON array of a parser's items) -> blocks.

    A positive text_level makes a title of any type; code and unknown types are text."""
    out = df.select(F.col(source).alias("source"), F.posexplode(F.from_json(content, CONTENT_LIST)).alias("pos", "x"))
    x, kind = F.col("x"), F.col("x.type")
    return _as_blocks(out.select(
        "source",
        F.when(F.coalesce(x["text_level"], F.lit(0)) > 0, "title").when(kind.isin("image", "list", "table", "equation", "discarded"), kind).otherwise("text").alias("kind"),
        item_text(x).alias("text"),
        F.coalesce(x["page_idx"], F.lit(0)).alias("page_idx"),
        F.coalesce(x["bbox"], F.array(*[F.lit(0)] * 4)).alias("bbox"),
        F.coalesce(x["text_level"], F.lit(0)).alias("title_level"),
        _or(x["html"], x["table_body"]).alias("html"),
        _or(x["img_path"]).alias("img_path"),
        _or_list(x["image_caption"], x["table_caption"], x["code_caption"]).alias("captions"),
        _or_list(x["image_footnote"], x["table_footnote"], x["code_footnote"]).alias("footnotes"),
        F.col("pos").alias("block_index"),
        F.col("pos").alias("reading_order"),
        F.to_json(x).alias("raw"),
    ))


def label_kind(label: Column) -> Column:
    """The kind of a layout label, which may carry the prefix of an enumeration's repr."""
    plain = F.regexp_replace(F.lower(label), r"^(docitemlabel|labeltype)\.", "")
    kinds = F.create_map(*[F.lit(v) for kv in LABEL_KINDS.items() for v in kv])
    return F.coalesce(F.element_at(kinds, plain), F.lit("text"))


def blocks_from_layout_list(df: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """(source, JSON array of plain layout items) -> blocks."""
    out = df.select(F.col(source).alias("source"), F.posexplode(F.from_json(content, LAYOUT_LIST)).alias("pos", "x"))
    x = F.col("x")
    return _as_blocks(out.select(
        "source", F.coalesce(label_kind(x["label"]), F.lit("text")).alias("kind"), _or(x["text"]).alias("text"),
        F.coalesce(x["page_idx"], F.lit(0)).alias("page_idx"), F.coalesce(x["bbox"], F.array(*[F.lit(0)] * 4)).alias("bbox"),
        F.coalesce(x["title_level"], F.lit(0)).alias("title_level"), _or(x["html"]).alias("html"), _or(x["img_path"]).alias("img_path"),
        _or_list(x["captions"]).alias("captions"), _or_list(x["footnotes"]).alias("footnotes"),
        F.col("pos").alias("block_index"), F.col("pos").alias("reading_order"), F.to_json(x).alias("raw"),
    ))


def normalized_bbox(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, origin: Column) -> Column:
    """array<int> [x0, y0, x1, y1] of thousandths of the page with the origin at the top left.

    Boxes measured from the bottom left, the usual case, are flipped; values are cut toward 0."""
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    below = F.upper(F.coalesce(origin, F.lit("BOTTOMLEFT"))).contains("BOTTOMLEFT")
    y0, y1 = (F.when(below, (h - y) / h * 1000).otherwise(y / h * 1000) for y in (top, bottom))
    return F.array(*[v.cast("int") for v in (left / w * 1000, y0, right / w * 1000, y1)])


def blocks_from_layout_items(df: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """(source, JSON array of layout items with provenance) -> a block for each provenance.

    Items without provenance lie on page 0 with an empty box. Blocks of one item share its
    reading order; block_index numbers all of a source's blocks."""
    out = df.select(F.col(source).alias("source"), F.posexplode(F.from_json(content, LAYOUT_ITEMS)).alias("item", "x"))
    out = out.select("source", "item", "x", F.posexplode_outer("x.prov").alias("k", "p")).withColumn("k", F.coalesce("k", F.lit(0)))
    x, p = F.col("x"), F.col("p")
    kind = F.coalesce(label_kind(x["label"]), F.lit("text"))
    plain = F.regexp_replace(F.lower(x["label"]), r"^(docitemlabel|labeltype)\.", "")
    level = F.when(plain == "title", 1).when(plain == "section_header", F.least(F.coalesce(x["level"], F.lit(0)) + 2, F.lit(6))).otherwise(0)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("item", "k")) - 1
    box = F.when(p.isNull(), F.array(*[F.lit(0)] * 4)).otherwise(normalized_bbox(p["l"], p["t"], p["r"], p["b"], x["page_w"], x["page_h"], p["origin"]))
    return _as_blocks(out.select(
        "source", kind.alias("kind"), _or(x["text"]).alias("text"), F.when(p.isNull(), 0).otherwise(p["page_no"] - 1).alias("page_idx"), box.alias("bbox"),
        level.alias("title_level"), _or(x["html"]).alias("html"), _or(x["img_path"]).alias("img_path"), _or_list(x["captions"]).alias("captions"), _or_list(x["footnotes"]).alias("footnotes"),
        place.alias("block_index"), F.col("item").alias("reading_order"), F.to_json(x).alias("raw"),
    ))


def keep_kinds(blocks: DataFrame, tables: bool = True, images: bool = True, equations: bool = True) -> DataFrame:
    """Leaves kinds out before anything is chunked; the filter reaches the scan."""
    out = [k for k, keep in (("table", tables), ("image", images), ("equation", equations)) if not keep]
    return blocks.filter(~F.col("kind").isin(out)) if out else blocks
