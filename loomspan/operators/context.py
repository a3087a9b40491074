"""What blocks and chunks know of their surroundings: breadcrumb, section, links, content, extras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.strings import filled, strip
from loomspan.schema import EXTRAS, STANDALONE

#: Blocks are in order by both: blocks of one item share its reading order.
ORDER = ("reading_order", "block_index")


def in_order() -> Window:
    return Window.partitionBy("source").orderBy(*ORDER)


def page_content(text: str = "text") -> Column:
    """The most telling text of a block: its text, a table's html, a table's or image's captions."""
    kind = F.col("kind")
    captions = F.when(F.size("captions") > 0, F.array_join("captions", " "))
    return F.coalesce(
        filled(F.col(text)),
        F.when(kind == "table", F.coalesce(filled(F.col("html")), captions)).when(kind == "image", captions),
        F.lit(""),
    )


def extras() -> Column:
    """html, img_path, captions and footnotes where there are any."""
    some = {"html": filled(F.col("html")), "img_path": filled(F.col("img_path")), "captions": F.when(F.size("captions") > 0, F.col("captions")), "footnotes": F.when(F.size("footnotes") > 0, F.col("footnotes"))}
    return F.struct(*[some.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EXTRAS])


def no_extras() -> Column:
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in EXTRAS])


def position() -> Column:
    return F.array(F.concat(F.array("page_idx"), "bbox"))


#: Places of the title stack that have a running window each; deeper ones are looked up in a list.
PLACES = 6


def with_breadcrumb(blocks: DataFrame) -> DataFrame:
    """``blocks`` with title_path and title_level in force at each block, itself included.

    A title cuts the stack of titles to its level less one, by number and not by level, and goes
    on top unless it is blank. So the stack's depth d is min(d before, level - 1) plus 1 for a
    title that goes on top, which unrolls to a running minimum of level - 1 less the titles put
    on top so far; and at each place of the stack is the last title that was put there. Both are
    running windows over one sort, in time proportional to the blocks.
    """
    w = in_order().rowsBetween(Window.unboundedPreceding, 0)
    title = F.col("kind") == "title"
    level = F.when(F.coalesce("title_level", F.lit(0)) == 0, 1).otherwise(F.col("title_level"))
    text = strip(F.col("text"))
    on_top = (title & (F.coalesce(text, F.lit("")) != "")).cast("int")
    d = blocks.withColumns({"_level": F.when(title, level), "_on_top": on_top, "_put": F.sum(on_top).over(w)})
    cut = F.when(title, F.greatest(F.col("_level") - 1, F.lit(0)) - (F.col("_put") - F.col("_on_top")))
    d = d.withColumn("_depth", F.coalesce(F.least(F.min(cut).over(w), F.lit(0)), F.lit(0)) + F.col("_put"))
    d = d.withColumn("_top", F.when(F.col("_on_top") == 1, F.struct(F.col("_depth").alias("at"), text.alias("text"))))
    places = [F.last(F.when(F.col("_top.at") == k, F.col("_top.text")), ignorenulls=True).over(w) for k in range(1, PLACES + 1)]
    deep = F.collect_list(F.when(F.col("_top.at") > PLACES, F.col("_top"))).over(w)
    d = d.withColumns({"_near": F.array(*places), "_deep": deep})
    last = lambda k: F.element_at(F.filter("_deep", lambda x: x["at"] == k), -1)["text"]
    stack = F.slice("_near", 1, F.least(F.col("_depth"), F.lit(PLACES)).cast("int"))
    whole = F.when(F.col("_depth") > PLACES, F.concat(stack, F.transform(F.sequence(F.lit(PLACES + 1).cast("long"), F.col("_depth")), last))).otherwise(stack)
    return d.withColumns({
        "title_path": F.array_join(whole, " > "),
        "title_level": F.coalesce(F.last("_level", ignorenulls=True).over(w), F.lit(0)).cast("int"),
    }).drop("_level", "_on_top", "_put", "_depth", "_top", "_near", "_deep")


def with_section(blocks: DataFrame) -> DataFrame:
    """``blocks`` with section_id: how many titles and standalone blocks stand up to each block."""
    edge = F.col("kind").isin("title", *STANDALONE).cast("int")
    return blocks.withColumn("section_id", F.sum(edge).over(in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def with_links(chunks: DataFrame, *order: str) -> DataFrame:
    """chunk_index by the given order, and the indices of the chunks before and after."""
    w = Window.partitionBy("source").orderBy(*order)
    d = chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    i = F.col("chunk_index")
    return d.withColumn("_n", n).withColumns({"prev_chunk_index": F.when(i > 0, i - 1), "next_chunk_index": F.when(i < F.col("_n") - 1, i + 1).cast("int")}).drop("_n")


def zone(chunks: DataFrame, top: int, bottom: int) -> DataFrame:
    """Chunks whose first box begins between two heights of its page."""
    y = F.get(F.get("position_int", F.lit(0)), F.lit(2))
    return chunks.filter((y >= top) & (y < bottom))


def spatial_neighbors(chunks: DataFrame, gap: int) -> DataFrame:
    """(source, page, chunk_index, neighbor_index): boxes of two chunks of one page at most ``gap``
    apart in height, one below the other.

    An equi-join on page and on bands of height ``gap``: a box joins its own band and the two
    beside it only, so a page's boxes are not all paired.
    """
    boxes = chunks.select("source", "chunk_index", F.explode("position_int").alias("p"))
    boxes = boxes.select("source", "chunk_index", F.get("p", F.lit(0)).alias("page"), F.get("p", F.lit(2)).alias("y0"), F.get("p", F.lit(4)).alias("y1"))
    size = max(gap, 1)
    low = boxes.select("source", "page", F.col("chunk_index").alias("a"), F.col("y1").alias("end"), F.explode(F.sequence(F.floor(F.col("y1") / size), F.floor((F.col("y1") + gap) / size))).alias("band"))
    high = boxes.select("source", "page", F.col("chunk_index").alias("b"), F.col("y0").alias("begin"), F.floor(F.col("y0") / size).alias("band"))
    found = low.join(high, ["source", "page", "band"]).filter((F.col("a") != F.col("b")) & (F.col("begin") >= F.col("end")) & (F.col("begin") - F.col("end") <= gap))
    return found.select("source", "page", F.col("a").alias("chunk_index"), F.col("b").alias("neighbor_index")).distinct()
