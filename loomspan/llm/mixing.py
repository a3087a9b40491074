"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from .common import JAVA_WORD, drop, joined_if_small, packed, row_key, table, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Keys of chosen documents that are broadcast at most (40 bytes each).
SMALL = 500_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with ``target`` and ``rank``, the source's number.

    Sources in code-point order, null last, take the weights in turn and divide ``share`` times
    all sizes. A target stops at ``most`` times its source's size; what it leaves is divided anew
    among the others by weight until none is above its stop. The ranks come from a range-sorted
    numbering, and every round is one distributed aggregate, so no task holds all sources.
    """
    spark = sizes.sparkSession
    ranked = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    ranked = spark.createDataFrame(ranked, "source string, source_size long, rank long")
    ranked = written(ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-sources")
    top = F.col("source_size") * F.lit(float(most))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:  # `level` is what a weight of 1 gets; it only rises, so sources that stop stay stopped
        at = F.col("w") * F.lit(level) > top
        n, fixed, free = ranked.agg(F.count_if(at), F.sum(F.when(at, top)), F.sum(F.when(~at, F.col("w")))).first()
        if n == stopped:
            break
        stopped, level = n, (total - (fixed or 0.0)) / free if free else level
        if not free:
            break
    return ranked.select("rank", "source", "source_size", F.least(top, F.col("w") * F.lit(level)).alias("target"))


#: Newton's steps at most, and the part of a target by which a solution may miss it.
STEPS, CLOSE = 100, 1e-9


def balanced(plan: DataFrame, most: float = 2.0) -> DataFrame:
    """(rank, size, n, target) -> with ``rate``: of all rates up to ``most`` of documents for which each source's sum of
    n * size * rate is its target, those nearest to 1 in entropy.

    They minimise sum(n * (r log r - r)), so r = min(most, exp(t * x)) with x the size over the
    source's mean and t its multiplier in the convex dual. Newton's steps for all sources' multipliers are taken at once: each
    is one distributed aggregate of gradients and curvatures over all rows, which the sources' new multipliers are
    written from. They stay inside brackets that shrink. Rows of size 0 have the rate 0.
    """
    some, cap = plan.filter("size > 0"), float(np.log(most))
    state = some.groupBy("rank").agg(F.first("target").alias("target"), F.sum(F.col("n") * F.col("size")).alias("mass"), F.sum("n").alias("docs"), F.min("size").alias("least"))
    first = F.col("least") * F.col("docs") / F.col("mass")
    full = F.col("target") >= F.col("mass") * F.lit(most * (1 - 1e-12))
    state = state.select("rank", "target", (F.col("mass") / F.col("docs")).alias("mean"), F.lit(0.0).alias("t"), (F.lit(-50.0) / first).alias("lo"), (F.lit(cap) / first).alias("hi"), full.alias("full"), full.alias("done"))
    state = written(state, "mix-state")
    for _ in range(STEPS):
        if not state.filter("not done").limit(1).count():
            break
        at = some.select("rank", "size", "n").join(state.filter("not done").select("rank", "mean", "t"), "rank")
        x, mass = F.col("size") / F.col("mean"), F.col("n") * F.col("size")
        e = F.least(F.col("t") * x, F.lit(cap))
        sums = at.groupBy("rank").agg(F.sum(mass * F.exp(e)).alias("_sum"), F.sum(F.when(e < cap, mass * x * F.exp(e)).otherwise(0.0)).alias("_slope"))
        gap = F.col("_sum") - F.col("target")
        new = state.join(sums, "rank", "left").withColumns({"_lo": F.when(gap > 0, F.col("lo")).otherwise(F.col("t")), "_hi": F.when(gap > 0, F.col("t")).otherwise(F.col("hi")), "_to": F.col("t") - gap / F.nullif(F.col("_slope"), F.lit(0.0))})
        inside = (F.col("_to") > F.col("_lo")) & (F.col("_to") < F.col("_hi"))
        met = F.col("done") | (F.abs(gap) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0)))
        moved = F.when(met, F.col("t")).when(inside, F.col("_to")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        new = new.select("rank", "target", "mean", moved.alias("t"), *[F.when(met, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("lo", "hi")], "full", met.alias("done"))
        before, state = state, written(new, "mix-state")
        drop(before)
    out = plan.join(state.select("rank", "mean", "t", "full"), "rank", "left")
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("full"), most).otherwise(F.least(F.exp(F.col("t") * F.col("size") / F.col("mean")), F.lit(most)))
    return out.withColumn("rate", rate).drop("mean", "t", "full")


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, most: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Whole copies: everyone of a size gets ``base`` copies and ``more`` of them one further.

    The longest are rounded first; what a size misses of its tokens passes to the next, so the
    sum ends within the smallest size of the target where room is left.
    """
    base, more, carry = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0.0
    for i in np.argsort(-size, kind="stable"):
        want = carry + rate[i] * n[i] * size[i]
        copies = int(np.clip(np.floor(want / size[i] + 0.5), 0, int(most) * n[i]))
        base[i], more[i] = divmod(copies, int(n[i]))
        carry = want - copies * size[i]
    return base, more


def mix_to_targets(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Every row of ``docs`` as the struct _row, with _size, _source_size, _target, _rate and _copies.

    Documents enter the optimisation as a histogram (source, size, number), aggregated before
    the shuffle: its rows per source are bounded by the lengths that texts can have, not by
    the number of documents. The rates come from ``balanced``; a task rounds those of a source's histogram.
    Among documents of one size those with the smallest hashes of key and text get the further
    copy. They are ranked by counts of hash ranges first and then within a range, so no task
    sorts a whole source. Reruns give the same copies.

    Null sources form one source. Rows of size 0 get no copy. Rows that equal each other in key
    and text are told apart by nothing, so which of them gets the further copy is open, but
    the number of copies is not.
    """
    d = packed(docs, _size=size.cast("long"), _source=F.col(source).cast("string"), _key=F.col(key), _h=F.xxhash64(*[c for c in (key, "text") if c in docs.columns]))
    hist = written(d.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = source_targets(hist.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("n")).alias("source_size")), weights, share, most)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf["_size"].to_numpy() > 0
        base, more = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        if some.any():
            s, n, rate = (pdf[c].to_numpy(float)[some] for c in ("_size", "n", "rate"))
            base[some], more[some] = rounded(s, n, rate, float(pdf["target"].iloc[0]), most)
        return pdf[["_source", "_size", "source_size", "target", "rate"]].assign(base=base, more=more)

    plan = hist.join(targets, hist["_source"].eqNullSafe(targets["source"])).drop("source")
    plan = balanced(written(plan.withColumnRenamed("_size", "size"), "mix-rates"), float(most)).withColumnRenamed("size", "_size")
    plan = plan.groupBy("rank").applyInPandas(whole, "_source string, _size long, source_size long, target double, rate double, base long, more long")
    plan = written(plan, "mix-plan")
    # which documents of a size get the further copy
    part = F.shiftrightunsigned("_h", 52)
    ranges = d.groupBy("_source", "_size", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before)
    p = plan.withColumnsRenamed({"_source": "_ps", "_size": "_pz"})
    ranges = ranges.join(p, ranges["_source"].eqNullSafe(p["_ps"]) & (ranges["_size"] == p["_pz"])).drop("_ps", "_pz")
    r = ranges.withColumnsRenamed({"_source": "_rs", "_size": "_rz", "_part": "_rp"})
    out = d.withColumn("_part", part)
    out = out.join(r, out["_source"].eqNullSafe(r["_rs"]) & (out["_size"] == r["_rz"]) & (out["_part"] == r["_rp"]))
    rank = F.row_number().over(Window.partitionBy("_source", "_size", "_part").orderBy("_h", "_key")) + F.col("_before")
    out = out.withColumn("_copies", F.col("base") + F.when(rank <= F.col("more"), 1).otherwise(0))
    return out.select("_row", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"), "_copies")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(JAVA_WORD))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("text"), n_words(F.col("text")).alias("_w"))
    out = mix_to_targets(written(small, "mix-docs"), F.col("_w"))
    return out.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").cast("long").alias("copies"), F.col("_rate").alias("rate"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row per copy, numbered by ``copy`` (which replaces a column of that name);
    documents without a copy go.

    Copies are chosen on keys; the rows themselves move once at most. Rows that are equal in all columns are
    one, with the sum of their copies.
    """
    every = [F.to_json(c) if isinstance(docs.schema[c].dataType, MapType) else F.col(f"`{c}`") for c in docs.columns]
    key = ["r1", "r2"]
    r1, r2 = row_key(*every)
    keys = written(docs.select(r1, r2, F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_w")), "mix-keys")
    chosen = mix_to_targets(keys, F.col("_w"), key="r1").select("_row.r1", "_row.r2", "_copies")
    chosen = written(chosen.groupBy(*key).agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0"), "mix-chosen")
    rows = packed(docs, r1=r1, r2=r2)
    out = joined_if_small(rows, chosen.filter("_rows = 1"), key, "inner", SMALL).select("_row", "_copies", F.lit(1).cast("long").alias("_rows"))
    twice = chosen.filter("_rows > 1")
    if twice.limit(1).count():
        equal = joined_if_small(rows, twice.select(key), key, "left_semi", SMALL).groupBy(*key).agg(F.first("_row").alias("_row"))
        out = out.unionByName(equal.join(twice, key).select("_row", "_copies", "_rows"))
    # of equal rows each has its share of the copies, those that come first one more
    number = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1), lambda i: (F.floor(i / F.col("_rows")) + 1).cast("int"))
    copies = out.select("_row", F.explode(number).alias("_copy"))
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c != "copy"], F.col("_copy").alias("copy"))
