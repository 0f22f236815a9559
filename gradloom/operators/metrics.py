"""Measures of runs and their repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The scalar measures that repeats are averaged over.
SCALARS = ("train_seconds", "epochs_per_sec", "samples_per_sec", "epochs_ran", "final_loss", "loss_per_sec", "accuracy", "accuracy_per_sec")
#: Weight of a new interval in the moving average, and its start in milliseconds.
EMA_WEIGHT, EMA_START = 0.3, 60_000.0


def run_metrics(runs: DataFrame) -> DataFrame:
    """Adds rates to runs (train_seconds, train_samples, loss_history, accuracy); null where a part is missing or zero."""
    n = F.size(F.coalesce("loss_history", F.array().cast("array<double>")))
    some = n > 0
    secs = F.when(F.col("train_seconds") != 0, F.col("train_seconds"))
    first, last = F.when(some, F.element_at("loss_history", 1)), F.when(some, F.element_at("loss_history", -1))
    return runs.withColumns(
        {
            "epochs_ran": n.cast("long"),
            "final_loss": last,
            "epochs_per_sec": n / secs,
            "samples_per_sec": F.when(F.col("train_samples") != 0, F.col("train_samples")) * n / secs,
            "loss_per_sec": (first - last) / secs,
            "accuracy_per_sec": F.col("accuracy") / secs,
        }
    )


def repeats(runs: DataFrame, key: str = "run_key", scalars: tuple[str, ...] = SCALARS, order: str = "repeat") -> DataFrame:
    """One row a key over its runs without an error: mean and population deviation of each measure, number of
    runs, whether any switched, and the loss history of the run whose final loss is nearest the mean.

    A key whose runs all failed has the measures and the error of its first run, and no number of runs.
    """
    own = [s for s in scalars if s in runs.columns]
    good = F.col("error").isNull()
    first = lambda c: F.min_by(c, order) if order in runs.columns else F.first(c)
    failed = F.count_if(good) == 0
    aggs = []
    for s in own:
        value = F.when(good, F.col(s))
        aggs.append(F.when(failed, first(F.col(s).cast("double"))).otherwise(F.avg(value)).alias(s))
        aggs.append(F.coalesce(F.stddev_pop(value), F.when(F.count(value) > 0, 0.0)).alias(f"{s}_std"))
    aggs += [F.when(~failed, F.count_if(good)).alias("repeats"), F.when(failed, first(F.col("error"))).alias("error")]
    if "switched" in runs.columns:
        aggs.append(F.when(failed, first(F.col("switched"))).otherwise(F.bool_or(F.when(good, F.col("switched")))).alias("switched"))
    out = runs.groupBy(key).agg(*aggs)
    if "loss_history" in runs.columns and "final_loss" in own:
        near = runs.filter(good & F.col("final_loss").isNotNull()).join(out.select(key, F.col("final_loss").alias("_mean")), key)
        near = near.groupBy(key).agg(F.min_by("loss_history", F.abs(F.col("final_loss") - F.col("_mean"))).alias("loss_history"))
        out = out.join(near, key, "left")
    return out


def newest(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record a key, the last by ``order``."""
    best = records.groupBy(key).agg(F.max_by(F.struct(*records.columns), order).alias("r"))
    return best.select("r.*")


def interval_ema(times: DataFrame, by: str, order: str, interval: str, weight: float = EMA_WEIGHT, start: float = EMA_START) -> DataFrame:
    """(by, ema): an exponential moving average over each worker's reports in order.

    The report with k others after it weighs ``weight * (1 - weight) ** k``, so that the average is a sum: no worker's
    reports are gathered in one value. Weights below the smallest float count as nothing, as in the fold.
    """
    after = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) - 1
    terms = times.select(by, after.alias("_after"), F.col(interval).cast("double").alias("_x"))
    left = F.lit(1 - weight)
    ema = F.sum(F.col("_x") * F.lit(weight) * F.pow(left, F.col("_after"))) + F.lit(float(start)) * F.pow(left, F.count(F.lit(1)))
    return terms.groupBy(by).agg(ema.alias("ema"))


def ping_stats(pings: DataFrame) -> DataFrame:
    """(src, dst, min, max, avg) of round-trip times."""
    return pings.groupBy("src", "dst").agg(F.min("rtt").alias("min_rtt"), F.max("rtt").alias("max_rtt"), F.avg("rtt").alias("avg_rtt"))


def server_choice(pings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (s1, s2, worst): of all pairs of nodes the one whose largest round trip to any other node is least,
    the first on ties. Nodes are dozens, so that pairs stay small."""
    edges = pings.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rtt").groupBy("a", "b").agg(F.max("rtt").alias("w"))
    both = edges.select("a", "b", "w").union(edges.select("b", "a", "w"))
    pairs = nodes.select(F.col("node").alias("s1")).join(nodes.select(F.col("node").alias("s2")), F.col("s1") < F.col("s2"))
    out = pairs.join(both, ((F.col("a") == F.col("s1")) & (F.col("b") != F.col("s2"))) | ((F.col("a") == F.col("s2")) & (F.col("b") != F.col("s1"))))
    worst = out.groupBy("s1", "s2").agg(F.max("w").alias("worst"))
    return worst.orderBy("worst", "s1", "s2").limit(1)
