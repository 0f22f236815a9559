"""Loss streams: convergence per run as a stateful operator, windowed means with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.control import ConvergenceTracker

OUT = "run string, epoch long, loss double"


def converged_runs(losses: DataFrame, tolerance: float) -> DataFrame:
    """From a stream (run string, epoch long, loss double): one row for each run at the epoch it converges.

    State is the last loss, the count of quiet losses and whether the run has ended. Losses of a run that
    come in one micro-batch are taken in order of epoch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, quiet, done = state.get if state.exists else (None, 0, False)
        tracker = ConvergenceTracker(tolerance, last=last, quiet=quiet)
        out = []
        for row in pd.concat(list(frames)).sort_values("epoch").itertuples():
            if not done and tracker.add(row.loss):
                done = True
                out.append((key[0], row.epoch, row.loss))
        state.update((tracker.last, tracker.quiet, done))
        yield pd.DataFrame(out, columns=["run", "epoch", "loss"])

    return losses.groupBy("run").applyInPandasWithState(step, OUT, "last double, quiet int, done boolean", "append", GroupStateTimeout.NoTimeout)


def running_loss(events: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, run, n, loss): mean loss by time window; what comes later than ``late`` is dropped."""
    g = events.withWatermark(time, late).groupBy(F.window(time, window), "run").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
    return g.select(F.col("window.start").alias("start"), "run", "n", "loss")
