"""Benchmark suites: run configurations, repeat, derive measures, and keep records as JSON lines."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from . import config as c
from . import models
from .operators import metrics
from .session import orchestrate
from .sources.tables import history, subset
from .sinks.reports import append_records

MODELS = {"lenet5": models.lenet5, "nielsen": lambda: models.nielsen(20), "small_conv": models.small_conv}


@dataclass(frozen=True)
class Run:
    """One configuration of a suite."""

    suite: str
    model: str
    strategy: str
    workers: int
    servers: int = 0
    lr: float = 0.05
    batch_size: int = 64
    offline_epochs: int = 0
    epochs: int = 60
    rows: int | None = None
    tolerance: float | None = None
    repeats: int = 1

    @property
    def run_key(self) -> str:
        return "|".join(str(v) for v in (self.suite, self.model, self.strategy, self.workers, self.servers, self.batch_size, self.offline_epochs))


#: Fixed values of the published campaign: learning rate and batch of each model, strategies with their servers.
SETTINGS = {"lenet5": (0.05, 64), "nielsen": (0.1, 10)}
STRATEGIES = (("all_reduce", 0), ("ps_barrier", 2), ("ps_async", 2), ("strategy_switch", 2))


def suites() -> Iterator[Run]:
    """Convergence, speed by batch and offline epochs, convergence speed, and scaling by workers.

    The grid's numbers are fixed values of the published campaign.
    """
    for model, (lr, batch) in SETTINGS.items():
        for strategy, servers in STRATEGIES:
            for workers in (3, 5, 7) if strategy == "all_reduce" else (3,):
                yield Run("convergence", model, strategy, workers, servers, lr, batch, tolerance=1e-4)
        for size, offline in ((64, 0), (64, 4), (256, 0)):
            yield Run("execution-speed", model, "all_reduce", 3, 0, lr, size, offline, 8, 4000, repeats=3)
        for strategy, servers in STRATEGIES:
            yield Run("convergence-speed", model, strategy, 5 if strategy == "all_reduce" else 3, servers, lr, 64, epochs=40)
        for strategy, servers, workers in (("all_reduce", 0, 3), ("all_reduce", 0, 5), ("all_reduce", 0, 7), ("ps_barrier", 2, 3), ("ps_barrier", 2, 5)):
            yield Run("scalability", model, strategy, workers, servers, lr, 64, epochs=8, rows=4000, repeats=3)


def training(run: Run, data: c.DataFrameDataset) -> c.TrainingConfig:
    args = (data, c.GradientDescent(run.lr), c.CrossEntropy())
    more = {"max_epochs": run.epochs, "batch_size": run.batch_size, "offline_epochs": run.offline_epochs, "seed": 1, "early_stopping_tolerance": run.tolerance}
    nodes = run.workers + run.servers
    if run.strategy == "all_reduce":
        return c.all_reduce(nodes, *args, **more)
    sync = c.NonBlockingSync() if run.strategy == "ps_async" else c.BarrierSync()
    make = c.strategy_switch if run.strategy == "strategy_switch" else c.parameter_server
    return make(nodes, run.servers, *args, sync=sync, store=c.BlockingStore(), **more)


def execute(spark: SparkSession, run: Run, train: DataFrame, test: DataFrame | None, x_size: int, y_size: int) -> list[dict]:
    """A record for each repeat; an error becomes part of its record."""
    rows = train if run.rows is None else subset(train, run.rows)
    data = c.DataFrameDataset(rows, x_size=x_size, y_size=y_size)
    n, out = rows.count(), []
    for repeat in range(run.repeats):
        record = asdict(run) | {"run_key": run.run_key, "repeat": repeat, "train_samples": n, "error": None, "train_seconds": None, "loss_history": [], "accuracy": None, "switched": None}
        try:
            session = orchestrate(spark, MODELS[run.model](), training(run, data))
            began = time.perf_counter()
            model = session.wait()
            record |= {"train_seconds": time.perf_counter() - began, "loss_history": model.loss_history(), "switched": model.switched}
            record["accuracy"] = None if test is None else model.accuracy(test, last_on_ties=False)
        except Exception as e:  # noqa: BLE001
            record["error"] = str(e)[:500]
        out.append(record)
    return out


RECORD = (
    "suite string, model string, strategy string, workers int, servers int, lr double, batch_size int, offline_epochs int, epochs int, rows long, tolerance double, "
    "repeats int, run_key string, repeat int, train_samples long, error string, train_seconds double, loss_history array<double>, accuracy double, switched boolean"
)


def run_suite(spark: SparkSession, runs: list[Run], train: DataFrame, test: DataFrame | None, x_size: int, y_size: int, folder: str) -> DataFrame:
    """Run, append to the folder of records, and return one row a configuration with means and deviations."""
    records = [r for run in runs for r in execute(spark, run, train, test, x_size, y_size)]
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in RECORD.split(", ")) for r in records], RECORD)
    measured = metrics.run_metrics(df)
    append_records(measured, folder)
    return summary(measured)


def summary(measured: DataFrame) -> DataFrame:
    first = measured.dropDuplicates(["run_key"]).select("run_key", "suite", "model", "strategy", "workers", "servers", "batch_size", "offline_epochs")
    return metrics.repeats(measured.drop("repeats")).join(first, "run_key")


def load_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest records of each configuration."""
    return history(spark, folder)
