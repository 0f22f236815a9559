"""Convergence, switch and loss operators over tables of losses, and their running forms for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_or_zero

#: Quiet epochs that stop a run, losses that a switch looks back on, and its threshold.
STOP_AFTER, SWITCH_WINDOW, SWITCH_BELOW = 3, 6, 0.01


@dataclass
class ConvergenceTracker:
    """Fires when ``window`` losses in a row stay within the tolerance of the one before. The first loss counts,
    and one that breaks the count is the first of the next."""

    tolerance: float
    window: int = STOP_AFTER
    last: float | None = None
    quiet: int = 0

    def add(self, loss: float) -> bool:
        if self.last is not None and abs(loss - self.last) > self.tolerance:
            self.quiet = 0
        self.quiet += 1
        self.last = loss
        return self.quiet >= self.window


@dataclass
class SwitchTracker:
    """Fires when the mean relative change over the window is at most the threshold."""

    window: int = SWITCH_WINDOW
    below: float = SWITCH_BELOW
    losses: list[float] = field(default_factory=list)

    def add(self, loss: float) -> bool:
        self.losses = [*self.losses, loss][-self.window :]
        if len(self.losses) < self.window:
            return False
        changes = [abs(b - a) / a if a else float("inf") for a, b in zip(self.losses, self.losses[1:], strict=False)]
        return sum(changes) / len(changes) <= self.below


def quiet_counts(losses: DataFrame, tolerance: float, order: str = "epoch", loss: str = "loss", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``quiet``: how many losses in a row, up to each epoch, are within the tolerance of the one before; the first
    loss of a row of them counts too. A group is one run, whose epochs a task holds."""
    w = Window.partitionBy(*by).orderBy(order)
    broken = F.abs(F.col(loss) - F.lag(loss).over(w)) > tolerance
    rows = losses.withColumn("_broken", F.coalesce(broken.cast("int"), F.lit(0))).withColumn("_island", F.sum("_broken").over(w))
    count = F.row_number().over(Window.partitionBy(*by, "_island").orderBy(order))
    return rows.withColumn("quiet", count.cast("long")).drop("_broken", "_island")


def convergence_epoch(losses: DataFrame, tolerance: float, window: int = STOP_AFTER, order: str = "epoch", loss: str = "loss", by: tuple[str, ...] = ()) -> DataFrame:
    """The first epoch at which the tracker fires, by group."""
    hit = quiet_counts(losses, tolerance, order, loss, by).filter(F.col("quiet") >= window)
    return hit.groupBy(*by).agg(F.min(order).alias("epoch"))


def switch_epoch(losses: DataFrame, below: float = SWITCH_BELOW, window: int = SWITCH_WINDOW, order: str = "epoch", loss: str = "loss", by: tuple[str, ...] = ()) -> DataFrame:
    """The first epoch at which the switch fires, by group."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.abs(F.col(loss) - F.lag(loss).over(w)) / F.lag(loss).over(w)
    rows = losses.withColumn("_rel", change).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_mean", F.avg("_rel").over(w.rowsBetween(-(window - 2), 0)))
    return rows.filter((F.col("_n") >= window) & (F.col("_mean") <= below)).groupBy(*by).agg(F.min(order).alias("epoch"))


def admitted(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """Losses that are zero or normal numbers."""
    return losses.filter(normal_or_zero(F.col(loss)))


def loss_by_epoch(losses: DataFrame, workers: int) -> DataFrame:
    """(epoch, n, max_loss, mean_loss, mean_of_reported): the first two only where all workers have reported."""
    full = F.col("n") == workers
    g = losses.groupBy("epoch").agg(F.count("loss").alias("n"), F.max("loss").alias("_max"), F.avg("loss").alias("mean_of_reported"))
    return g.select("epoch", "n", F.when(full, F.col("_max")).alias("max_loss"), F.when(full, F.col("mean_of_reported")).alias("mean_loss"), "mean_of_reported")


def mean_of_workers(losses: DataFrame, promoted: DataFrame) -> DataFrame:
    """(epoch, loss): mean over the workers that have the epoch, leaving out those that became servers."""
    return losses.join(promoted, "worker", "left_anti").groupBy("epoch").agg(F.avg("loss").alias("loss"))


def worker_state(events: DataFrame) -> DataFrame:
    """(worker, epochs_done, last_loss, became_server) from events (seq, kind, worker, epoch, loss)."""
    return events.groupBy("worker").agg(
        F.count_if(F.col("kind") == "loss").alias("epochs_done"),
        F.max_by("loss", F.when(F.col("kind") == "loss", F.col("seq"))).alias("last_loss"),
        F.bool_or(F.col("kind") == "became_server").alias("became_server"),
    )


def union_events(*frames: DataFrame) -> DataFrame:
    """Typed events of several listeners as one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
