"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, comp): comp is the smallest node reachable. Nodes without edges don't occur.

    Alternates the large-star and small-star steps, which keep connectivity and turn each
    component into a star around its smallest node within about log(n)**2 rounds. Groups are
    aggregated before they are shuffled; nothing gathers a component in one task. Each round
    is a written table, so a lost executor costs that round at most.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, now = now, written(small.filter("u <> v").distinct(), "cc")
        drop(before)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u"), F.count_if(F.col("u") < F.col("v"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
