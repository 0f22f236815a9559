"""Running a training: plan, rounds, stop reasons, the trained model."""

from __future__ import annotations

import logging
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as c
from .kernels.layers import Network
from .kernels.training import Optimiser, local_training, loss_of
from .operators.control import ConvergenceTracker, SwitchTracker
from .operators.partitioning import partitioned, redistributed
from .plans.initial import initial_params, resolve_seed
from .plans.lowering import layer_params, network
from .plans.topology import roles
from .plans.validate import validate, validate_rows
from .sinks.model import params_table, save_safetensors
from .sources.tables import count_rows, filesystem, load, shared_folder
from .strategies import AllReduceRun, ParameterServerRun, Results, Strategy

log = logging.getLogger("gradloom")

EVENTS = "seq long, kind string, worker int, epoch int, loss double, detail string"
#: Vectors of all workers that go through the driver whole, in bytes together, and values of a part beyond that.
COLLECTED_BYTES, PART_VALUES = 64 << 20, 1 << 20
MAX_EPOCHS, EARLY, MANUAL = "max_epochs_reached", "early_stopping", "manual_stop"


class TrainingError(RuntimeError):
    """A run that can't go on."""


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a worker as two matrices."""
    xs, ys = [], []
    for b in batches:
        if b.num_rows:
            for out, name in ((xs, "x"), (ys, "y")):
                col = b.column(name)
                out.append(col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(b.num_rows, -1))
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))


def _kernel(net: Network, shared, t: c.TrainingConfig, epochs: int, seed: int | None, first_epoch: int):
    loss, batch, lr = loss_of(t.loss_fn), t.batch_size, t.optimizer.lr
    schema = pa.schema([("worker", pa.int32()), ("losses", pa.list_(pa.float64())), ("grad", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        x, y = _columns(batches)
        losses, grad = local_training(net, shared.of(worker), x, y, loss, batch, lr, epochs, seed, worker, first_epoch)
        yield pa.RecordBatch.from_arrays([pa.array([worker], pa.int32()), pa.array([losses], pa.list_(pa.float64())), pa.array([grad.tobytes()], pa.binary())], schema=schema)

    return run


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Workers' results cut into parts of the vector, each value rounded to half precision: (part, worker, losses, body)."""
    for batch in batches:
        for worker, losses, grad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = np.frombuffer(grad, np.float32)
            for part, at in enumerate(range(0, len(body), size)):
                with np.errstate(over="ignore"):
                    half = body[at : at + size].astype("<f2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (worker, pa.int32()), (losses, pa.list_(pa.float64())), (half, pa.binary()))], names=["part", "worker", "losses", "body"])


def _mean(table: pa.Table) -> pa.Table:
    """One part's mean over the workers, in their order, with the losses."""
    table = table.sort_by("worker")
    bodies = table.column("body").to_pylist()
    total = np.zeros(len(bodies[0]) // 2, np.float64)
    for body in bodies:
        total += np.frombuffer(body, "<f2").astype(np.float32)
    mean = (total / len(bodies)).astype(np.float32).tobytes()
    part = table.column("part")[0].as_py()
    # Losses come back once, with the first part.
    workers, losses = (table.column("worker").to_pylist(), table.column("losses").to_pylist()) if not part else ([], [])
    return pa.table({"part": pa.array([part], pa.int32()), "workers": pa.array([workers], pa.list_(pa.int32())), "losses": pa.array([losses], pa.list_(pa.list_(pa.float64()))), "body": pa.array([mean], pa.binary())})


class Start:
    """What the workers of a round start from. One vector, or vectors of all workers that are small together, are broadcast;
    beyond that each worker's vector is a file of its own in the shared folder, and a worker reads no other."""

    def __init__(self, spark: SparkSession, params: np.ndarray):
        self.shared, self.folder = None, None
        if params.ndim == 1 or params.nbytes <= COLLECTED_BYTES:
            self.shared = spark.sparkContext.broadcast(params)
            return
        self.folder = shared_folder(spark)
        fs, root = filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        for worker, own in enumerate(params):
            with fs.open_output_stream(f"{root}/{worker}") as out:
                out.write(own.astype("<f4").tobytes())

    def of(self, worker: int) -> np.ndarray:
        if self.shared is not None:
            start = self.shared.value
            return start[worker] if start.ndim == 2 else start
        fs, root = filesystem(self.folder)
        with fs.open_input_file(f"{root}/{worker}") as source:
            return np.frombuffer(source.read(), "<f4")

    def free(self) -> None:
        if self.shared is not None:
            self.shared.unpersist()
        else:
            fs, root = filesystem(self.folder)
            fs.delete_dir(root)


@dataclass
class TrainedModel:
    """Parameters of a finished run with its history."""

    spark: SparkSession
    model: c.Sequential
    x_size: int
    params: np.ndarray
    history: list[list[float]]
    events: DataFrame
    stop_reason: str
    seed: int
    switched: bool

    def weights(self) -> DataFrame:
        """(layer, name, shape, values)."""
        return params_table(self.spark, self.model, self.x_size, self.params)

    def loss_history(self) -> list[float]:
        """Mean loss of all workers, by epoch that all of them ran."""
        return [float(np.mean(e)) for e in self.history]

    def save_safetensors(self, path: str) -> None:
        save_safetensors(path, self.model, self.x_size, self.params)

    def save_parquet(self, path: str) -> None:
        self.weights().write.mode("overwrite").parquet(path)

    def predict(self, df: DataFrame, features: str = "x") -> DataFrame:
        """Adds ``prediction array<float>``; rows stay where they lie."""
        net, shared = network(self.model, self.x_size), self.spark.sparkContext.broadcast(self.params)
        kept = [f for f in df.schema if f.name != "prediction"]
        rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(features).cast("array<float>").alias("_in"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("_in").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    p = net.forward(shared.value, x.astype(np.float32, copy=False))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(b.num_columns - 1)], lists], names=[*b.schema.names[:-1], "prediction"])

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["prediction array<float>"])
        return rows.mapInArrow(run, schema)

    def accuracy(self, df: DataFrame, last_on_ties: bool = True) -> float:
        """Share of rows whose largest output is the largest label; equal outputs go to the last or the first."""

        def best(col: str):
            order = F.transform(col, lambda v, i: F.struct(v.alias("v"), (i if last_on_ties else -i).alias("i")))
            return F.array_max(order)["i"]

        return self.predict(df).agg(F.avg((best("prediction") == best("y")).cast("double"))).first()[0]


@dataclass
class Session:
    """A run that has been planned. ``wait`` trains and may be called once; ``stop`` ends it at the next round."""

    spark: SparkSession
    model: c.Sequential
    training: c.TrainingConfig
    net: Network
    data: DataFrame
    rows: int
    seed: int
    servers: list[int]
    strategy: Strategy
    on_epoch: object = None
    events: list[dict] = field(default_factory=list)
    switched: bool = False
    _stop: threading.Event = field(default_factory=threading.Event)
    _used: bool = False

    def stop(self) -> None:
        self._stop.set()

    def _event(self, kind: str, worker: int | None = None, epoch: int | None = None, loss: float | None = None, detail: str | None = None) -> None:
        self.events.append({"seq": len(self.events), "kind": kind, "worker": worker, "epoch": epoch, "loss": c.loss_to_wire(loss) if loss is not None else None, "detail": detail})

    def _round(self, epochs: int, first_epoch: int) -> tuple[Results, np.ndarray | None]:
        """One job: a task a worker, one row back from each, or, where gradients of all workers are large together, the
        mean gradient in parts that were added up part by part."""
        t, size = self.training, self.net.size
        shared = Start(self.spark, self.strategy.start_params())
        kernel = _kernel(self.net, shared, t, epochs, self.seed if t.shuffle else None, first_epoch)
        try:
            if not self.strategy.needs_mean_alone or 4 * size * self.strategy.workers <= COLLECTED_BYTES:
                rows = self.data.mapInArrow(kernel, "worker int, losses array<double>, grad binary").collect()
                return {r["worker"]: (list(r["losses"]), np.frombuffer(r["grad"], np.float32)) for r in rows}, None
            parts = self.data.mapInArrow(lambda batches: _parts(kernel(batches), PART_VALUES), "part int, worker int, losses array<double>, body binary")
            rows = parts.groupBy("part").applyInArrow(_mean, "part int, workers array<int>, losses array<array<double>>, body binary").collect()
        finally:
            shared.free()
        rows.sort(key=lambda r: r["part"])
        nothing = np.zeros(0, np.float32)
        return {w: (list(x), nothing) for w, x in zip(rows[0]["workers"], rows[0]["losses"], strict=True)}, np.concatenate([np.frombuffer(r["body"], np.float32) for r in rows])

    def wait(self) -> TrainedModel:
        if self._used:
            raise TrainingError("a session can be waited for once")
        self._used = True
        try:
            return self._train()
        finally:
            self.data.unpersist()

    def _train(self) -> TrainedModel:
        t = self.training
        stopper = ConvergenceTracker(t.early_stopping.tolerance) if t.early_stopping else None
        switch = SwitchTracker() if isinstance(t.algorithm, c.StrategySwitch) else None
        epoch, round_no, reason, history = 0, 0, None, []
        while epoch < t.max_epochs and reason is None:
            if self._stop.is_set():
                reason = MANUAL
                break
            epochs = min(1 + t.offline_epochs, t.max_epochs - epoch)
            results, mean = self._round(epochs, epoch)
            for worker in sorted(results):
                for k, loss in enumerate(results[worker][0]):
                    if not np.isfinite(loss):
                        raise TrainingError(f"worker {worker} reports a loss of {loss} in epoch {epoch + k}")
                    self._event("loss", worker, epoch + k, loss)
            for k in range(epochs):
                history.append([results[w][0][k] for w in sorted(results)])
                if self.on_epoch:
                    self.on_epoch(epoch + k, float(np.mean(history[-1])))
            if mean is not None:
                self.strategy.apply_mean(mean)
            else:
                for e in self.strategy.finish_round(results, round_no):
                    self._event(e["kind"], e.get("worker"), epoch, None, e.get("detail"))
            epoch, round_no = epoch + epochs, round_no + 1
            worst = max(r[0][-1] for r in results.values())
            log.info("epoch %d: loss %.6g", epoch, worst)
            if stopper and stopper.add(worst):
                reason = EARLY
            elif switch and not self.switched and switch.add(worst) and epoch < t.max_epochs:
                self._promote(epoch)
        reason = reason or MAX_EPOCHS
        self._event("stop", detail=reason)
        events = self.spark.createDataFrame([tuple(e.values()) for e in self.events], EVENTS)
        return TrainedModel(self.spark, self.model, t.dataset.x_size, self.strategy.params, history, events, reason, self.seed, self.switched)

    def _promote(self, epoch: int) -> None:
        """Turn to parameter servers: some workers give their rows to the others and serve from now on."""
        t, before = self.training, self.strategy
        for worker in self.servers:
            self._event("became_server", worker, epoch)
        old, workers = self.data, t.n_nodes - t.n_servers
        self.data = _placed(redistributed(old.select("row_id", "x", "y", "worker"), self.servers, t.n_nodes), workers)
        self.data.count()
        old.unpersist()
        self.strategy = _servers(self.model, t, before.params, workers, self.seed)
        self.switched = True
        self._event("switch", epoch=epoch, detail=f"workers={workers}")


def _placed(df: DataFrame, workers: int) -> DataFrame:
    """One partition a worker, in row order, kept in memory or on disk between rounds."""
    return df.repartitionById(workers, F.col("worker")).sortWithinPartitions("row_id").persist()


def _arrival(seed: int):
    """A recorded, repeatable order of pushes."""
    return lambda round_no, workers: [workers[k] for k in np.random.default_rng([seed, round_no]).permutation(len(workers))]


def _servers(model: c.Sequential, t: c.TrainingConfig, params: np.ndarray, workers: int, seed: int) -> ParameterServerRun:
    ratio = t.serializer.keep_ratio if isinstance(t.serializer, c.SparseSerializer) else None
    return ParameterServerRun(params, workers, ratio, kind=t.algorithm, sizes=layer_params(model, t.dataset.x_size), optimizer=t.optimizer, order=_arrival(seed))


def orchestrate(spark: SparkSession, model: c.Sequential, training: c.TrainingConfig, on_epoch=None) -> Session:
    """Validate, plan and place the data of a run."""
    t = training
    validate(model, t)
    seed = resolve_seed(t.seed)
    data = load(spark, t.dataset)
    rows = count_rows(data, t.dataset.x_size, t.dataset.y_size)
    validate_rows(t, rows)
    if rows < t.n_workers:
        raise c.ConfigError(f"{rows} rows can't be shared by {t.n_workers} workers")
    servers, _ = roles(t.n_nodes, t.n_servers, t.latencies)
    # Row numbers of a DataFrame may have gaps; those of the other sources run from 0.
    counted = None if isinstance(t.dataset, c.DataFrameDataset) else rows
    placed = _placed(partitioned(data, t.n_workers, counted), t.n_workers)
    params = initial_params(model, t.dataset.x_size, seed)
    if type(t.algorithm) is c.ParameterServer:
        strategy: Strategy = _servers(model, t, params, t.n_workers, seed)
    else:
        ratio = t.serializer.keep_ratio if isinstance(t.serializer, c.SparseSerializer) else None
        strategy = AllReduceRun(params, t.n_workers, ratio, optimiser=Optimiser(t.optimizer, len(params)))
    return Session(spark, model, t, network(model, t.dataset.x_size), placed, rows, seed, servers, strategy, on_epoch)


def progress(epoch: int, loss: float) -> None:
    """A line an epoch, for ``orchestrate(..., on_epoch=progress)``."""
    print(f"epoch {epoch + 1}: loss {loss:.3e}" if abs(loss) < 1e-4 else f"epoch {epoch + 1}: loss {loss:.8f}", flush=True)
