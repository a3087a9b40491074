"""Removal of boilerplate lines that spread over many distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_if_small, packed, row_key, table, written

#: A line on at least this many distinct sites is boilerplate.
SITES = 8
#: A sketch has 2**LG_K registers; once full, its relative error is about 1.04 / sqrt(2**LG_K).
LG_K = 10
#: Estimates that differ from SITES by more than this share decide alone; nearer ones are counted.
BAND = 0.25
#: A line frames a text if lines that are spread over sites are at most this share of the text; it is boilerplate
#: if it frames at least this share of the different texts that have it.
FRAME = 0.5
#: Lines, or lines to remove, that are broadcast at most (about 50 bytes each).
SMALL = 300_000


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def keyed_lines(docs: DataFrame, site: str, text: str) -> DataFrame:
    """(r1, r2, t, whole, site, place, line, h1, h2): the non-blank lines of all rows. r1, r2 name a row's
    id and text, h1, h2 the line without outer white space, by 128 bits each, t the text, whose
    length is whole."""
    lines = docs.select(*row_key("doc_id", text), F.xxhash64(text).alias("t"), F.length(text).alias("whole"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text), "\n")).alias("place", "line"))
    lines = lines.withColumn("line", trimmed(F.col("line"))).filter("line <> ''")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2, n_sites) of the lines on at least ``sites`` distinct sites.

    Each line hash has a HyperLogLog sketch of its sites, built before the shuffle and merged
    after it: a line of a third of all documents moves one sketch per task. Estimates within
    BAND of the threshold give way to exact distinct counts, made for those lines alone from
    pairs (line, site) that are deduplicated before they are shuffled.
    """
    sketch = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    found = sketch.filter(F.col("n") >= sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("n_sites"))
    found = written(found.filter(F.col("n_sites") >= sites * (1 - BAND)), "ld-lines")
    sure = found.filter(F.col("n_sites") > sites * (1 + BAND))
    near = found.filter(F.col("n_sites") <= sites * (1 + BAND)).select("h1", "h2")
    exact = joined_if_small(lines.select("h1", "h2", "site"), near, ["h1", "h2"], "left_semi", SMALL).distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_sites")).filter(F.col("n_sites") >= sites)
    return sure.unionByName(exact)


def framing(marks: DataFrame) -> DataFrame:
    """(h1, h2) of the spread lines that frame texts: (t, whole, place, h1, h2, size) of all their places.

    The lines of a text that stands on many sites are spread as well, but they are most of each text
    that has them. Different texts have one vote each, however many copies there are.
    """
    marks = marks.select("t", "whole", "place", "h1", "h2", "size").distinct()
    share = marks.groupBy("t").agg((F.sum("size") <= F.max("whole") * FRAME).alias("frames"))
    votes = marks.select("t", "h1", "h2").distinct().join(share, "t")
    return votes.groupBy("h1", "h2").agg(F.count_if("frames").alias("yes"), F.count(F.lit(1)).alias("all")).filter(F.col("yes") >= F.col("all") * FRAME).select("h1", "h2")


def drop_spread_lines(docs: DataFrame, site: str = "source", text: str = "text", sites: int = SITES) -> DataFrame:
    """``docs`` without the lines of spread_lines that frame texts, with n_removed (which replaces a
    column of that name); all rows stay.

    Lines are compared without outer white space; blank ones stay. Whether a line is boilerplate
    is decided for the line, over all texts that have it, not for a document: then it goes from
    every document, whatever its share of it. Lines that make up most of most of their
    texts are those of texts copied between sites, which are left to near-duplicate detection.
    A null site counts as the site ''. Null and empty texts have no lines and stay as they
    are. Equal rows get equal results.
    """
    lines = keyed_lines(docs, site, text)
    spread = written(spread_lines(lines, sites), "ld-spread").select("h1", "h2")
    marks = lines.select("r1", "r2", "t", "whole", "place", "h1", "h2", F.length("line").alias("size"))
    marks = written(joined_if_small(marks, spread, ["h1", "h2"], "left_semi", SMALL), "ld-marks")
    boiler = written(framing(marks), "ld-boiler")
    gone = joined_if_small(marks, boiler, ["h1", "h2"], "left_semi", SMALL)
    gone = gone.select("r1", "r2", "place").distinct().groupBy("r1", "r2").agg(F.array_sort(F.collect_list("place")).alias("_places"))
    gone = written(gone, "ld-gone")
    n, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_places")), F.lit(0))).first()
    if max(n, places) <= SMALL:
        gone = F.broadcast(gone)
    r1, r2 = row_key("doc_id", text)
    rows = packed(docs, r1=r1, r2=r2)
    out, whole = rows.join(gone, ["r1", "r2"], "left"), F.col("_row").getField(text)
    ours = F.col("_places").isNotNull()
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_places"), lambda i: F.get("_lines", i))
    out = out.withColumn("_lines", F.when(ours, F.split(whole, "\n")))
    out = out.withColumn("_text", F.when(ours, F.array_join(left, "\n")).otherwise(whole))
    kept = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c != "n_removed"]
    return out.select(*kept, F.when(ours, F.size("_places")).otherwise(0).cast("long").alias("n_removed"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_spread_lines(docs).select("doc_id", "n_removed", "text")


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
trimmed AS (SELECT *, regexp_replace(line, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS t FROM lines),
spread AS (SELECT t FROM trimmed WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= {SITES}),
marked AS (SELECT doc_id, text, line, place, t, t IN (SELECT t FROM spread) AS hit FROM trimmed),
share AS (SELECT text, sum(length(t)) <= length(text) * {FRAME} AS frames FROM (SELECT DISTINCT text, place, t FROM marked WHERE hit) GROUP BY text),
boiler AS (SELECT t FROM (SELECT DISTINCT text, t FROM marked WHERE hit) JOIN share USING (text) GROUP BY t HAVING count(*) FILTER (frames) >= count(*) * {FRAME}),
judged AS (SELECT *, t IN (SELECT t FROM boiler) AS gone FROM marked),
docs AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS rest FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_removed, CASE WHEN n > 0 THEN coalesce(rest, '') ELSE d.text END AS text
FROM documents d LEFT JOIN docs USING (doc_id)
"""


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without boilerplate lines, n_chars with them; all documents stay."""
    out = drop_spread_lines(packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
