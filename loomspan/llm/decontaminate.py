"""Benchmark decontamination by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_if_small, packed, row_key, table, written

#: Masks over SPAN tokens: the places that count. The others may hold anything.
SPAN = 8
MASKS = ((0, 1, 3, 6, 7), (0, 2, 4, 5, 7))
#: A mismatch costs what this many matches earn; a segment ends where its sum is greatest.
MISMATCH = 2
#: Segments of fewer matches don't count, and a document is contaminated by an item if the counted
#: segments of one neighbourhood hold this many different tokens of it, or SHARE percent of a shorter item.
SEGMENT_LEAST, MATCHES_LEAST, SHARE = 6, 12, 80
#: A segment ends where its sum has fallen this far below its greatest; what follows is a segment of its own.
FALL = 6
#: Segments that begin within this many item lengths are one neighbourhood.
REACH = 2
#: Diagonals on either side of a hit's that are laid over as well: tokens put in or dropped move what follows.
BESIDE = 2
#: Items of fewer tokens than this are ordinary phrases inside a text: they count as whole lines only.
ITEM_LEAST = 5
#: Tokens of items that are broadcast at most.
TOKENS = 2_000_000
#: Seeds that are broadcast at most (about 24 bytes each), and documents with hits.
SMALL = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; punctuation and symbols are left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.array_remove(F.split(plain, r"\s+"), "")


def windows(rows: DataFrame, keep: list[str], length: int, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(keep..., place, seed) for every run of ``length`` tokens in column ``toks`` and every mask."""
    n = F.greatest(F.size("toks") - (length - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("toks", j + 1, n) for j in range(length)])
    found = rows.filter(F.size("toks") >= length).select(*keep, F.posexplode(zipped).alias("place", "_z"))
    seeds = [F.xxhash64(F.lit(length * 100 + m), *[F.col("_z").getField(str(j)) for j in mask]) for m, mask in enumerate(masks)]
    return found.select(*keep, "place", F.explode(F.array(*seeds)).alias("seed"))


def needed(size: Column | int):
    """Different tokens of an item of ``size`` tokens that a document must hold."""
    if isinstance(size, int):
        return size if size < SPAN else min(MATCHES_LEAST, -(-size * SHARE // 100))
    return F.when(size < SPAN, size).otherwise(F.least(F.lit(MATCHES_LEAST), F.ceil(size * SHARE / 100).cast("int")))


#: Items below this length need fewer than MATCHES_LEAST tokens; they are compared over whole diagonals.
SHORT = next(n for n in range(SPAN, 100) if needed(n) == MATCHES_LEAST)


def short_masks(size: int) -> tuple[tuple[int, ...], ...]:
    """Masks over a whole item of ``size`` tokens. As many substitutions as needed() allows leave two
    of the blocks unchanged, so one of the masks, the pairs of blocks, finds it."""
    blocks = size - needed(size) + 2
    cut = [size * i // blocks for i in range(blocks + 1)]
    parts = [tuple(range(a, z)) for a, z in zip(cut, cut[1:])]
    return tuple(a + b for a, b in combinations(parts, 2)) if size >= SPAN else (tuple(range(size)),)


def segments(same: Column) -> Column:
    """array<struct<n, first, last>>: the segments of positive sum (matches less mismatch costs), each
    up to its greatest sum."""
    kind = "array<struct<n:int,first:int,last:int>>"
    start = F.struct(F.array().cast(kind).alias("found"), *[F.lit(v).alias(k) for k, v in (("sum", 0), ("n", 0), ("first", 0), ("i", 0), ("best", 0), ("best_n", 0), ("best_last", -1))])

    def closed(a: Column) -> Column:
        return F.when(a["best"] > 0, F.concat(a["found"], F.array(F.struct(a["best_n"].alias("n"), a["first"].alias("first"), a["best_last"].alias("last"))))).otherwise(a["found"])

    def step(a: Column, x: Column) -> Column:
        fresh = (a["sum"] <= 0) | (a["best"] - a["sum"] >= FALL)
        total = F.when(fresh, 0).otherwise(a["sum"]) + F.when(x, 1).otherwise(-MISMATCH)
        n = F.when(fresh, 0).otherwise(a["n"]) + F.when(x, 1).otherwise(0)
        was = F.when(fresh, 0).otherwise(a["best"])
        better = total > was
        return F.struct(
            F.when(fresh, closed(a)).otherwise(a["found"]).alias("found"), total.alias("sum"), n.alias("n"), F.when(fresh, a["i"]).otherwise(a["first"]).alias("first"), (a["i"] + 1).alias("i"),
            F.when(better, total).otherwise(was).alias("best"), F.when(better, n).otherwise(F.when(fresh, 0).otherwise(a["best_n"])).alias("best_n"), F.when(better, a["i"]).otherwise(a["best_last"]).alias("best_last"),
        )

    return F.aggregate(same, start, step, closed)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text), (item_id, text) -> (doc_id, item_id, matches, first, last, r1, r2).

    Seeds of all items are joined with the seeds of every document: broadcast if their
    number is small, else by shuffle. A hit proposes a diagonal; on each diagonal the item is
    laid over the whole document's tokens, there and at its neighbours, and all its segments of positive sum are taken, which
    may contain substituted tokens. Segments of all diagonals that begin near each other in the
    document add up, so inserted, dropped or many substituted tokens don't hide a passage.
    ``matches`` counts different tokens of the item, and no token of the document twice: a phrase
    that is repeated counts once. ``first`` and ``last`` are token numbers in the document, of
    the neighbourhood with most matches (the first of these).

    Null texts have no tokens. Rows with equal id and text give equal rows, once. Items of equal
    id are taken as one row each. Items shorter than SPAN must occur whole and unchanged, and
    those shorter than ITEM_LEAST as a line of their own;
    of items shorter than SHORT, with seeds of their own, needed() says how many tokens must stay.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("toks")).filter(F.size("toks") > 0)
    every = written(items.distinct().withColumn("item", F.xxhash64("item_id", "toks")), "dc-items")
    items, tiny = every.filter(F.size("toks") >= ITEM_LEAST), every.filter(F.size("toks") < ITEM_LEAST)
    rows = docs.select(*row_key("doc_id", "text"), "doc_id", "text")
    spaced = [(SPAN, MASKS)]
    short = [r[0] for r in items.filter(F.size("toks") < SHORT).select(F.size("toks")).distinct().collect()]  # 9 lengths at most
    spaced += [(n, short_masks(n)) for n in sorted(short)]
    hits = []
    toks = rows.select("r1", "r2", tokens(F.col("text")).alias("toks"))
    for k, (length, masks) in enumerate(spaced):
        own = items if k == 0 else items.filter(F.size("toks") == length)
        seeds = written(windows(own, ["item"], length, masks).withColumnRenamed("place", "at").distinct(), "dc-seeds")
        found = joined_if_small(windows(toks, ["r1", "r2"], length, masks), seeds, ["seed"], "inner", SMALL)
        hits.append(found.select("r1", "r2", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct())
    hits = reduce(DataFrame.unionByName, hits).distinct()
    hits = hits.select("r1", "r2", "item", F.explode(F.sequence(F.col("diagonal") - BESIDE, F.col("diagonal") + BESIDE)).alias("diagonal")).distinct()
    hits = written(hits.groupBy("r1", "r2", "item").agg(F.collect_list("diagonal").alias("diagonals")), "dc-hits")
    met = written(hits.select("r1", "r2").distinct(), "dc-met")
    near = joined_if_small(rows, met, ["r1", "r2"], "left_semi", SMALL).dropDuplicates(["r1", "r2"]).select("r1", "r2", "doc_id", tokens(F.col("text")).alias("_doc"))
    laid = hits.join(near, ["r1", "r2"])
    held = items.agg(F.sum(F.size("toks"))).first()[0] or 0
    laid = laid.join(F.broadcast(items) if held <= TOKENS else items, "item").select("r1", "r2", "doc_id", "item", "item_id", "_doc", "toks", F.explode("diagonals").alias("d"))
    begin = F.greatest(F.col("d"), F.lit(0))
    size = F.greatest(F.least(F.size("_doc") - begin, F.size("toks") - (begin - F.col("d"))), F.lit(0))
    same = F.zip_with(F.slice("_doc", begin + 1, size), F.slice("toks", begin - F.col("d") + 1, size), lambda x, y: x == y)
    matched = F.size(F.filter("same", lambda x: x))
    whole = F.array(F.struct(matched.alias("n"), F.lit(0).alias("first"), (F.size("same") - 1).alias("last")))
    found = laid.select("r1", "r2", "doc_id", "item", "item_id", F.size("toks").alias("size"), "d", begin.alias("begin"), same.alias("same"))
    found = found.withColumn("s", F.explode(F.when(F.col("size") < SHORT, whole).otherwise(segments(F.col("same"))))).filter(F.col("s.n") >= F.least(F.lit(SEGMENT_LEAST), "size"))
    places = F.filter(F.sequence(F.col("s.first"), F.col("s.last")), lambda i: F.get("same", i))
    found = found.select("r1", "r2", "doc_id", "item", "item_id", "size", (F.col("begin") + F.col("s.first")).alias("first"), (F.col("begin") + F.col("s.last")).alias("last"), F.transform(places, lambda i: i + F.col("begin")).alias("in_doc"), F.transform(places, lambda i: i + F.col("begin") - F.col("d")).alias("in_item"))
    near = found.withColumn("at", F.col("first").cast("double") / F.col("size"))
    over = f"OVER (PARTITION BY r1, r2, doc_id, item, item_id, size ORDER BY at RANGE BETWEEN CURRENT ROW AND {REACH}D FOLLOWING)"
    near = near.select("r1", "r2", "doc_id", "item", "item_id", "size", "first", F.expr(f"max(last) {over}").alias("last"), *[F.size(F.array_distinct(F.flatten(F.expr(f"collect_list({c}) {over}")))).alias(f"n_{c}") for c in ("in_doc", "in_item")])
    best = near.groupBy("r1", "r2", "doc_id", "item", "item_id", "size").agg(F.max(F.struct(F.least("n_in_doc", "n_in_item").alias("n"), (-F.col("first")).alias("first"), F.col("last"))).alias("best"))
    best = best.filter(F.col("best.n") >= needed(F.col("size")))
    found = best.select("doc_id", "item_id", F.col("best.n").cast("long").alias("matches"), (-F.col("best.first")).cast("long").alias("first_token"), F.col("best.last").cast("long").alias("last_token"), "r1", "r2")
    return found.unionByName(whole_lines(rows, tiny)) if tiny.limit(1).count() else found


def whole_lines(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of leaks() for items that count as whole lines: of each the first line that is it."""
    lines = rows.select("r1", "r2", "doc_id", F.posexplode(F.split("text", "\n")).alias("_place", "_line")).withColumn("toks", tokens(F.col("_line")))
    short = lines.filter(F.size("toks").between(1, ITEM_LEAST - 1)).select("r1", "r2", "doc_id", "_place", "toks")
    met = joined_if_small(short, items, ["toks"], "inner", SMALL).select("r1", "r2", "item_id", F.size("toks").cast("long").alias("matches"), "_place")
    met = written(met.groupBy("r1", "r2", "item_id", "matches").agg(F.min("_place").alias("_place")), "dc-lines")
    texts = joined_if_small(rows, met.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi", SMALL).dropDuplicates(["r1", "r2"])
    before = F.aggregate(F.transform(F.slice(F.split("text", "\n"), 1, F.col("_place")), tokens), F.lit(0), lambda n, x: n + F.size(x)).cast("long")
    found = met.join(texts, ["r1", "r2"]).select("doc_id", "item_id", "matches", before.alias("first_token"), "r1", "r2")
    return found.select("doc_id", "item_id", "matches", "first_token", (F.col("first_token") + F.col("matches") - 1).alias("last_token"), "r1", "r2")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark")).drop("r1", "r2").distinct()


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go."""
    found = written(leaks(docs, table(spark, sf_dir, "benchmark")).select("r1", "r2").distinct(), "dc-found")
    r1, r2 = row_key("doc_id", "text")
    rows = packed(docs, r1=r1, r2=r2)
    return joined_if_small(rows, found, ["r1", "r2"], "left_anti", SMALL).select("_row.*")
