"""Contiguous worker partitions, batches and seeded row orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges that global ranks are made of, at most: their bounds are literals of the plan. Beyond, ranges get larger.
MOST_RANGES = 10_000


def in_ranges(df: DataFrame, key: str, out: str = "_range") -> DataFrame:
    """Adds the number of a key range, in order of a numeric key. Bounds are quantiles, fixed as literals, so that
    every evaluation deals rows alike; a row looks for its range among groups of bounds, then in its group."""
    n = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.approxQuantile(key, [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    if not bounds:
        return df.withColumn(out, F.lit(0))
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    up_to = lambda values: F.size(F.filter(values, lambda b: b <= F.col(key)))
    group = up_to(F.lit([g[0] for g in groups]))
    inner = F.when(group == 0, 0).otherwise((group - 1) * width + up_to(F.element_at(F.array(*map(F.lit, groups)), F.greatest(group, F.lit(1)))))
    return df.withColumn(out, inner)


def numbered(df: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """Adds ranks from 0 over the whole table in order of a numeric, unique key.

    Ranges are ranked side by side and shifted by the counts before them; no task sees more than a range.
    """
    rows = in_ranges(df, key)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most MOST_RANGES rows.
    before = F.broadcast(counts.select("_range", before.alias("_before")))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return own.join(before, "_range").withColumn(out, F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def _block(at: Column, n: int, rows: int) -> Column:
    """The block of place ``at`` when ``rows`` places are cut into n blocks, the first ones longer."""
    base, extra = divmod(rows, n)
    short = F.lit(extra) + F.floor((at - F.lit(extra * (base + 1))) / F.lit(max(base, 1)))
    return F.when(at < extra * (base + 1), F.floor(at / F.lit(base + 1))).otherwise(short).cast("int")


def partitioned(df: DataFrame, workers: int, rows: int | None = None, key: str = "row_id") -> DataFrame:
    """Adds ``worker``: n contiguous blocks, the first rows % n of them one row longer.

    With row numbers from 0 (``rows`` given) a row's block is arithmetic and needs no shuffle; otherwise
    rows are ranked first.
    """
    if rows is not None:
        return df.withColumn("worker", _block(F.col(key), workers, rows))
    return numbered(df, key, "_rank").withColumn("worker", _block(F.col("_rank"), workers, df.count())).drop("_rank")


def batched(df: DataFrame, size: int, order: str = "row_id") -> DataFrame:
    """Adds ``batch``: consecutive rows of each worker; the last batch may be short."""
    w = Window.partitionBy("worker").orderBy(order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def shuffled(df: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Adds ``position``: a row order within each worker that follows from seed and epoch, by a digest that any engine has."""
    w = Window.partitionBy("worker").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), "row_id").cast("binary")), "row_id")
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def redistributed(df: DataFrame, promoted: list[int], workers: int) -> DataFrame:
    """Rows of promoted workers move to those that stay, each promoted worker's rows cut evenly among them;
    staying workers are numbered anew."""
    stay = [k for k in range(workers) if k not in promoted]
    if not stay:
        raise ValueError("no worker stays")
    number = F.create_map(*[v for new, old in enumerate(stay) for v in (F.lit(old), F.lit(new))])
    share = F.ntile(len(stay)).over(Window.partitionBy("worker").orderBy("row_id")) - 1
    moved = F.col("worker").isin(*promoted)
    return df.withColumn("_share", share).withColumn("worker", F.when(moved, F.col("_share")).otherwise(F.element_at(number, F.col("worker"))).cast("int")).drop("_share")


def row_slice(df: DataFrame, start: int, n: int) -> DataFrame:
    return df.filter((F.col("row_id") >= start) & (F.col("row_id") < start + n))


def value_range(values: Column, start: int, n: int) -> Column:
    """n values from position ``start`` of an array."""
    return F.slice(values, start + 1, n)


def chunks(df: DataFrame, n: int, order: str) -> DataFrame:
    """Adds ``chunk``: a vector in long form cut into n contiguous parts, the first ones longer."""
    return numbered(df, order, "_rank").withColumn("chunk", _block(F.col("_rank"), n, df.count())).drop("_rank")


def prefix_ranges(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Adds start and end: running sums of ``size`` within a group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(size).over(w).cast("long")).withColumn("start", (F.col("end") - F.col(size)).cast("long"))
