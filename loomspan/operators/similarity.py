"""Segmentation of runs of vectors by windows and aggregates: the built-in parts of semantic chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.vectors import cosine, savitzky_golay


def neighbor_similarity(v: DataFrame, run: str = "run_id", order: str = "vec_id", ahead: int = 1) -> DataFrame:
    """``v`` with sim: the greatest cosine with the next ``ahead`` vectors; a run's last row goes."""
    w = Window.partitionBy(run).orderBy(order)
    if ahead == 1:
        return v.withColumn("_next", F.lead("vec").over(w)).filter("_next is not null").withColumn("sim", cosine(F.col("vec"), F.col("_next"))).drop("_next")
    d = v.withColumn("_next", F.collect_list("vec").over(w.rowsBetween(1, ahead))).filter(F.size("_next") > 0)
    return d.withColumn("sim", F.array_max(F.transform("_next", lambda x: cosine(F.col("vec"), x)))).drop("_next")


def moving_average(s: DataFrame, window: int, run: str = "run_id", order: str = "vec_id") -> DataFrame:
    """sim -> smooth: a centred average of ``window`` values (odd), with zeros beyond the ends."""
    h = window // 2
    return s.withColumn("smooth", F.sum("sim").over(Window.partitionBy(run).orderBy(order).rowsBetween(-h, h)) / window)


def polynomial_smooth(s: DataFrame, window: int, degree: int, run: str = "run_id", order: str = "vec_id", derivative: int = 0, out: str = "smooth") -> DataFrame:
    """sim -> smooth: least-squares polynomials over ``window`` values, or a derivative of theirs.

    In a run that is shorter the window shrinks to the largest odd number of its values, and the
    degree to what that determines; a window of 1 leaves values as they are, with derivatives of 0. At the ends the polynomials
    of the first and last window are evaluated."""
    window -= window % 2 == 0
    w = Window.partitionBy(run).orderBy(order)
    d = s.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(run)))
    d = d.withColumn("_w", F.least(F.lit(window), F.col("_n") - (F.col("_n") % 2 == 0).cast("int")).cast("int"))
    begin = F.least(F.greatest(F.col("_i") - F.floor(F.col("_w") / 2), F.lit(0)), F.col("_n") - F.col("_w"))
    d = d.withColumn("_near", F.collect_list("sim").over(w.rowsBetween(-(window - 1), window - 1))).withColumn("_first", F.greatest(F.col("_i") - (window - 1), F.lit(0)))
    weights = None
    for size in range(3, window + 1, 2):
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in savitzky_golay(size, min(degree, size - 1), derivative)])
        weights = F.when(F.col("_w") == size, rows) if weights is None else weights.when(F.col("_w") == size, rows)
    plain = F.lit(0.0) if derivative else F.col("sim")
    if weights is None:
        return s.withColumn(out, plain)
    values = F.slice("_near", (begin - F.col("_first") + 1).cast("int"), F.col("_w"))
    fitted = F.aggregate(F.zip_with(values, F.get(weights, (F.col("_i") - begin).cast("int")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return d.withColumn(out, F.when(F.col("_w") > 1, fitted).otherwise(plain)).drop("_i", "_n", "_w", "_near", "_first")


def breakpoints(s: DataFrame, percent: float | None = 25.0, threshold: float | None = None, value: str = "sim", run: str = "run_id") -> DataFrame:
    """``s`` with is_break: the value is below the run's percentile, or below ``threshold``."""
    if threshold is None:
        bound = s.groupBy(run).agg(F.percentile(value, F.lit(percent / 100)).alias("_bound"))
        return s.join(bound, run).withColumn("is_break", F.col(value) < F.col("_bound")).drop("_bound")
    return s.withColumn("is_break", F.col(value) < threshold)


def local_minima(s: DataFrame, window: int = 3, degree: int = 2, percent: float = 25.0, tolerance: float = 0.1, run: str = "run_id", order: str = "vec_id") -> DataFrame:
    """``s`` with smooth and is_break: where the fitted polynomial is nearly level (a slope below ``tolerance``), curves
    upwards, and is not above the run's percentile of smoothed values."""
    d = polynomial_smooth(s, window, degree, run, order)
    for k, name in ((1, "_slope"), (2, "_curve")):
        d = polynomial_smooth(d, window, degree, run, order, k, name)
    bound = F.percentile("smooth", F.lit(percent / 100)).over(Window.partitionBy(run))
    return d.withColumn("is_break", (F.abs("_slope") < tolerance) & (F.col("_curve") > 0) & (F.col("smooth") <= bound)).drop("_slope", "_curve")


def segments(v: DataFrame, percent: float = 25.0, run: str = "run_id", order: str = "vec_id") -> DataFrame:
    """``v`` with segment: how many breaks lie before each vector of its run."""
    marked = breakpoints(neighbor_similarity(v, run, order), percent, run=run).select(run, order, "is_break")
    w = Window.partitionBy(run).orderBy(order)
    d = v.join(marked, [run, order], "left")
    return d.withColumn("segment", F.coalesce(F.sum(F.col("is_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).drop("is_break")


def centroids(v: DataFrame, *group: str) -> DataFrame:
    """The mean vector of each group as (group, pos, mean)."""
    return v.select(*group, F.posexplode("vec").alias("pos", "x")).groupBy(*group, "pos").agg(F.avg("x").alias("mean"))
