"""Element-wise steps over parameter vectors in long form: optimisers, averages, compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import in_ranges, numbered


def gd_step(p: Column, g: Column, lr: float) -> Column:
    return p - F.lit(lr) * g


def momentum_step(p: Column, g: Column, v: Column, lr: float, mu: float) -> tuple[Column, Column]:
    """(parameter, velocity)."""
    v2 = F.lit(mu) * v + g
    return p - F.lit(lr) * v2, v2


def adam_step(p: Column, g: Column, v: Column, s: Column, t: int, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> tuple[Column, Column, Column]:
    """(parameter, first moment, second moment) of step t, counted from 1."""
    v2 = F.lit(b1) * v + F.lit(1 - b1) * g
    s2 = F.lit(b2) * s + F.lit(1 - b2) * g * g
    step = lr * (1 - b2**t) ** 0.5 / (1 - b1**t)
    return p - F.lit(step) * v2 / (F.sqrt(s2) + F.lit(eps)), v2, s2


def mean_gradient(grads: DataFrame, workers: int) -> DataFrame:
    """(dim, value) from (worker, dim, value): the barrier's average."""
    return grads.groupBy("dim").agg((F.sum("value") / workers).alias("value"))


def exact_threshold(values: DataFrame, keep_ratio: float, value: str = "value") -> DataFrame:
    """One row: the k-th smallest size, k = floor(n * (1 - keep_ratio)), at least 2**-14.

    Sizes are counted, then summed up range by range; only the range that holds the k-th is sorted.
    """
    n = values.count()
    k = min(int(n * (1 - keep_ratio)), max(n - 1, 0))
    sizes = values.groupBy(F.abs(F.col(value)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = in_ranges(sizes, "size")
    totals = sizes.groupBy("_range").agg(F.sum("n").alias("_n"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter((F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k))
    own = sizes.join(F.broadcast(totals.select("_range", "_before")), "_range")
    seen = F.sum("n").over(Window.partitionBy("_range").orderBy("size"))
    return own.withColumn("_seen", F.col("_before") + seen).filter(F.col("_seen") > k).agg(F.greatest(F.min("size"), F.lit(2.0**-14)).alias("threshold"))


def approximate_threshold(values: DataFrame, keep_ratio: float, value: str = "value") -> DataFrame:
    return values.agg(F.greatest(F.percentile_approx(F.abs(F.col(value)), F.lit(1 - keep_ratio)), F.lit(2.0**-14)).alias("threshold"))


def kept_runs(values: DataFrame, threshold: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """(start, length, gap): stretches of entries of at least the threshold, with the gap before each.

    A run starts at a kept position whose predecessor isn't kept and ends at one whose successor isn't; the
    k-th start belongs to the k-th end, and the gap lies behind the end before.
    """
    least = threshold.first()[0]
    kept = values.filter(F.abs(F.col(value)) >= F.lit(least)).select(F.col(pos).cast("long").alias("pos"))
    beside = lambda by: kept.join(kept.select((F.col("pos") + by).alias("pos")), "pos", "left_anti")
    starts = numbered(beside(1), "pos", "k").withColumnRenamed("pos", "start")
    ends = numbered(beside(-1), "pos", "k").withColumnRenamed("pos", "last")
    before = ends.select((F.col("k") + 1).alias("k"), F.col("last").alias("_before"))
    runs = starts.join(ends, "k").join(before, "k", "left")
    return runs.select("start", (F.col("last") - F.col("start") + 1).alias("length"), (F.col("start") - F.coalesce("_before", F.lit(-1)) - 1).alias("gap"))
