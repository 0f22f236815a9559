"""One query per operator of the training engine, and the SQL that states its result.

``embeddings`` serves as a table of 1x8x8 images with ten labels; weights are closed forms of their
indices, so that any engine can compute them. Values are rounded, with ``+ 0.0`` against negative zeros.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as c
from . import models
from .functions import columns as fn
from .kernels import codec
from .operators import control, layers, metrics, partitioning, vectors
from .plans import topology
from .plans.initial import draw
from .plans.lowering import layer_params
from .plans.placement import placement
from .plans.validate import layer_sizes
from .session import orchestrate
from .sources.tables import append, filesystem, history, idx_images, idx_labels, local, one_hot, shared_folder, subset

WORKERS, BATCH = 7, 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def weight(i: Column, j: Column) -> Column:
    """A fixed small weight for a pair of indices."""
    return ((i * 7 + j * 3) % 11 - 5) / F.lit(50.0)


def _kernel(f: Column, kh: Column, kw: Column) -> Column:
    return ((f * 5 + kh * 3 + kw) % 7 - 3) / F.lit(10.0)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.long_form(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.dense_by_expression(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, weight)


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.softmax(_logits(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "label")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a dataset; row numbers are the ids' ranks, which run from 0 here."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"), one_hot(F.col("label"), 10).cast("array<float>").alias("y"))


def _grid(spark: SparkSession, *sizes: tuple[str, int]) -> DataFrame:
    """All combinations of small indices."""
    df = spark.range(1).drop("id")
    for name, n in sizes:
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df


def _weights(spark: SparkSession) -> DataFrame:
    return _grid(spark, ("i", 64), ("j", 10)).select("i", "j", weight(F.col("i"), F.col("j")).alias("value"))


def _kernels(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    k = _grid(spark, ("f", 3), ("c", 1), ("kh", 3), ("kw", 3)).withColumn("value", _kernel(F.col("f"), F.col("kh"), F.col("kw")))
    return k, _grid(spark, ("f", 3)).select("f", (F.col("f") / F.lit(10.0)).alias("value"))


# Partitioning


def partition_sizes(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = partitioning.partitioned(rows, WORKERS, rows.count())
    return out.groupBy(F.col("worker").cast("long").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def batch_index(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = partitioning.batched(partitioning.partitioned(rows, WORKERS, rows.count()), BATCH)
    return out.select("row_id", F.col("worker").cast("long").alias("worker"), "batch")


def redistribution(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = partitioning.redistributed(partitioning.partitioned(rows, WORKERS, rows.count()), [0, 3], WORKERS)
    return out.groupBy(F.col("worker").cast("long").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def vector_chunks(spark, sf_dir):
    params = _weights(spark).select((F.col("i") * 10 + F.col("j")).alias("dim"), "value")
    return partitioning.chunks(params, 7, "dim").groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.min("dim").cast("long").alias("first"), F.count(F.lit(1)).alias("n"))


def shuffled_order(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = partitioning.shuffled(partitioning.partitioned(rows, WORKERS, rows.count()), 42, 1)
    return out.select("row_id", F.col("worker").cast("long").alias("worker"), "position")


def one_hot_labels(spark, sf_dir):
    out = _rows(spark, sf_dir).select("row_id", F.posexplode("y").alias("k", "v"))
    return out.select("row_id", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))


def append_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return append(rows, subset(rows, 100)).select("row_id", F.round(F.element_at("x", 1).cast("double"), 6).alias("x0"))


def subset_rows(spark, sf_dir):
    return subset(_rows(spark, sf_dir), 100).select("row_id", F.size("x").cast("long").alias("width"))


def row_slice(spark, sf_dir):
    out = partitioning.row_slice(_rows(spark, sf_dir), 100, 50)
    return out.select("row_id", _r(F.aggregate(partitioning.value_range(F.col("x"), 8, 8), F.lit(0.0), lambda a, v: a + v)).alias("s"))


# Layers


def dense_forward(spark, sf_dir):
    return _logits(spark, sf_dir).select(F.col("row").alias("vec_id"), F.col("j").cast("long").alias("j"), _r(F.col("value")).alias("z"))


def dense_join(spark, sf_dir):
    bias = _grid(spark, ("j", 10)).select("j", (F.col("j") / F.lit(7.0)).alias("value"))
    z = layers.dense(_images(spark, sf_dir), _weights(spark), bias)
    return z.select(F.col("row").alias("vec_id"), F.col("j").cast("long").alias("j"), _r(F.col("value")).alias("z"))


def dense_backward(spark, sf_dir):
    p = _probabilities(spark, sf_dir).join(_labels(spark, sf_dir), "row")
    delta = p.select("row", "j", (F.col("value") - (F.col("j") == F.col("label")).cast("double")).alias("value"))
    out = layers.dense_input_delta(delta, _weights(spark))
    return out.select(F.col("row").alias("vec_id"), F.col("i").cast("long").alias("i"), _r(F.col("value")).alias("dx"))


def softmax(spark, sf_dir):
    return _probabilities(spark, sf_dir).select(F.col("row").alias("vec_id"), F.col("j").cast("long").alias("j"), _r(F.col("value")).alias("p"))


def softmax_backward(spark, sf_dir):
    a = _probabilities(spark, sf_dir)
    d = a.select("row", "j", ((F.col("j") + 1) / F.lit(7.0)).alias("value"))
    return layers.softmax_delta(a, d).select(F.col("row").alias("vec_id"), F.col("j").cast("long").alias("j"), _r(F.col("value")).alias("d"))


def softmax_grad(spark, sf_dir):
    p = _probabilities(spark, sf_dir).join(_labels(spark, sf_dir), "row")
    delta = p.select("row", "j", (F.col("value") - (F.col("j") == F.col("label")).cast("double")).alias("value"))
    w, _ = layers.dense_gradients(_images(spark, sf_dir), delta)
    return w.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _r(F.col("value"), 4).alias("g"))


def conv2d_pad1(spark, sf_dir):
    f, _, kh, kw = np.indices((3, 1, 3, 3))
    out = layers.conv2d_map(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ((f * 5 + kh * 3 + kw) % 7 - 3) / 10.0, np.arange(3) / 10.0, 8, 8, 1, 1)
    return out.select(F.col("row").alias("vec_id"), "f", "oy", "ox", _r(F.col("value")).alias("z"))


def conv2d_join(spark, sf_dir):
    """The same over images and kernels in long form, at stride 2."""
    k, b = _kernels(spark)
    out = layers.conv2d(_images(spark, sf_dir), k, b, 8, 8, 3, 2, 1)
    return out.select(F.col("row").alias("vec_id"), *[F.col(n).cast("long").alias(n) for n in ("f", "oy", "ox")], _r(F.col("value")).alias("z"))


def max_pool_padded(spark, sf_dir):
    """Windows of 3 at stride 2 over a border of zeros."""
    out = layers.max_pool(_images(spark, sf_dir), 8, 8, 3, 2, 1)
    return out.select(F.col("row").alias("vec_id"), F.col("oy").cast("long").alias("oy"), F.col("ox").cast("long").alias("ox"), _r(F.col("value")).alias("m"))


def conv2d_gradient(spark, sf_dir):
    k, b = _kernels(spark)
    images = _images(spark, sf_dir)
    out = layers.conv2d(images, k, b, 8, 8, 3, 2, 1)
    g, _ = layers.conv2d_gradients(images, out, 8, 8, 3, 2, 1)
    return g.select(*[F.col(n).cast("long").alias(n) for n in ("f", "kh", "kw")], _r(F.col("value"), 4).alias("g"))


def conv2d_input_delta(spark, sf_dir):
    k, b = _kernels(spark)
    out = layers.conv2d(_images(spark, sf_dir), k, b, 8, 8, 3, 1, 1)
    d = layers.col2im(out, k, 8, 8, 1, 1)
    return d.select(F.col("row").alias("vec_id"), F.col("r").cast("long").alias("r"), F.col("q").cast("long").alias("q"), _r(F.col("value")).alias("d"))


def max_pool(spark, sf_dir):
    out = layers.max_pool(_images(spark, sf_dir), 8, 8, 2, 2)
    return out.select(F.col("row").alias("vec_id"), F.col("oy").cast("long").alias("oy"), F.col("ox").cast("long").alias("ox"), _r(F.col("value")).alias("m"), F.col("at").cast("long").alias("place"))


def max_pool_backward(spark, sf_dir):
    pooled = layers.max_pool(_images(spark, sf_dir), 8, 8, 2, 2)
    out = layers.max_pool_delta(pooled, pooled.drop("at"), 2, 2)
    return out.select(F.col("row").alias("vec_id"), F.col("r").cast("long").alias("r"), F.col("q").cast("long").alias("q"), _r(F.col("value")).alias("d"))


def reshape_round_trip(spark, sf_dir):
    out = layers.to_image(_images(spark, sf_dir), 8, 8)
    back = layers.to_flat(out, 8, 8)
    return back.select(F.col("row").alias("vec_id"), F.col("i").cast("long").alias("i"), _r(F.col("value")).alias("v"))


def activations(spark, sf_dir):
    x = F.col("value")
    s, t = fn.sigmoid(x, 2.0), fn.tanh(x, 1.5)
    return _images(spark, sf_dir).select(
        F.col("row").alias("vec_id"),
        F.col("i").cast("long").alias("i"),
        _r(s).alias("sig"),
        _r(t).alias("tnh"),
        _r(fn.leaky_relu(x, 0.1)).alias("lrelu"),
        _r(fn.sigmoid_slope(s, 2.0)).alias("dsig"),
        _r(fn.tanh_slope(t, 1.5)).alias("dtnh"),
        _r(fn.leaky_relu_slope(x, 0.1)).alias("dlrelu"),
    )


# Losses and accuracy


def cross_entropy(spark, sf_dir):
    p = _probabilities(spark, sf_dir).join(_labels(spark, sf_dir), "row")
    y = (F.col("j") == F.col("label")).cast("double")
    return p.agg(_r(F.sum(fn.cross_entropy_term(F.col("value"), y)) / F.count(F.lit(1))).alias("loss"), F.count(F.lit(1)).alias("n"))


def linreg_gradient(spark, sf_dir):
    d = F.lit(0.01) * F.col("l_quantity") - F.col("l_extendedprice") / 99991.0
    out = _table(spark, sf_dir, "lineitem").select(d.alias("d"), F.col("l_quantity").alias("q"))
    return out.agg(_r(F.avg(fn.squared_error(F.col("d"), F.lit(0.0)))).alias("loss"), _r(F.avg(F.lit(2.0) * F.col("d") * F.col("q")), 4).alias("g_w"), _r(F.avg(F.lit(2.0) * F.col("d"))).alias("g_b"))


def argmax_accuracy(spark, sf_dir):
    p = _probabilities(spark, sf_dir)
    both = layers.argmax(p).join(_labels(spark, sf_dir), "row").join(layers.argmax(p, last=False).withColumnRenamed("pred", "first"), "row")
    hit = lambda c_: F.avg((F.col(c_) == F.col("label")).cast("double"))
    return both.agg(_r(hit("pred")).alias("acc_last"), _r(hit("first")).alias("acc_first"), F.count(F.lit(1)).alias("n"))


def _traces(spark, sf_dir) -> DataFrame:
    """(worker, epoch, loss): events by user and day stand in for reports."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).cast("long").alias("worker"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("epoch")).agg(F.avg("value").alias("loss"))


def loss_by_epoch(spark, sf_dir):
    out = control.loss_by_epoch(_traces(spark, sf_dir), 5)
    return out.select("epoch", "n", *[_r(F.col(k)).alias(k) for k in ("max_loss", "mean_loss", "mean_of_reported")])


def mean_without_promoted(spark, sf_dir):
    promoted = spark.createDataFrame([(1,), (3,)], "worker long")
    return control.mean_of_workers(_traces(spark, sf_dir), promoted).select("epoch", _r(F.col("loss")).alias("loss"))


def _hourly(spark, sf_dir) -> DataFrame:
    """(run, epoch, loss): means of 20 events in a row, for each type."""
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.floor(F.col("event_id") / 200).cast("long").alias("epoch"), "value")
    return e.groupBy("run", "epoch").agg(F.avg("value").alias("loss"))


def convergence_epoch(spark, sf_dir):
    return control.convergence_epoch(_hourly(spark, sf_dir), 5.0, by=("run",))


def quiet_counts(spark, sf_dir):
    return control.quiet_counts(_hourly(spark, sf_dir), 5.0, by=("run",)).select("run", "epoch", "quiet")


def switch_epoch(spark, sf_dir):
    return control.switch_epoch(_hourly(spark, sf_dir), below=0.2, by=("run",))


def loss_admission(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).when(F.col("event_id") % 7 == 2, F.lit(1e-310)).when(F.col("event_id") % 7 == 3, F.lit(0.0)).otherwise(F.col("value"))
    out = control.admitted(_table(spark, sf_dir, "events").select("event_id", v.alias("loss")))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def loss_format(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 3 == 0, F.col("value") / 99991000.0).when(F.col("event_id") % 3 == 1, -F.col("value") / 7.0).otherwise(F.col("value"))
    return e.select("event_id", fn.format_loss(x).alias("shown"))


def worker_state(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 97 == 0, "became_server").otherwise("loss").alias("kind"),
        (F.col("user_id") % 8).cast("long").alias("worker"),
        F.col("value").alias("loss"),
    )
    return control.worker_state(e).select("worker", "epochs_done", _r(F.col("last_loss")).alias("last_loss"), "became_server")


def event_union(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    # Three listeners share all events.
    own = lambda k, kind: e.filter(F.col("event_id") % 3 == k).withColumn("kind", F.lit(kind)).withColumnRenamed("event_id", "seq")
    a, b, d = own(0, "loss"), own(1, "stop"), own(2, "push")
    return control.union_events(a.select("seq", "kind", F.col("value").alias("loss")), b.select("seq", "kind"), d.select("seq", "kind", F.col("user_id").alias("worker")))


# Metrics


def _runs(spark, sf_dir) -> DataFrame:
    """Orders of a customer stand in for repeats of a run."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.concat_ws("|", F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("run_key"),
        F.col("o_orderkey").alias("id"),
        F.when((F.col("o_orderkey") % 11 == 0) | (F.col("o_custkey") % 50 == 7), F.concat(F.lit("failed "), F.col("o_orderkey"))).alias("error"),
        (F.col("o_totalprice") / 99991.0).alias("final_loss"),
        F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_totalprice") / 7.0).alias("train_seconds"),
        (F.col("o_orderkey") % 13 == 0).alias("switched"),
        F.array((F.col("o_totalprice") / 13.0).cast("double"), (F.col("o_totalprice") / 99991.0).cast("double")).alias("loss_history"),
    )


def repeats_agg(spark, sf_dir):
    out = metrics.repeats(_runs(spark, sf_dir), scalars=("train_seconds", "final_loss"), order="id")
    return out.select("run_key", "repeats", "switched", "error", _r(F.element_at("loss_history", 1), 4).alias("first_loss"), *[_r(F.col(k), 4).alias(k) for k in ("train_seconds", "train_seconds_std", "final_loss", "final_loss_std")])


def run_metrics(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    history = F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("o_totalprice") / 7.0, F.col("o_totalprice") / 13.0, F.col("o_totalprice") / 17.0))
    runs = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(F.col("o_custkey") / 7.0).alias("train_seconds"),
        F.col("o_custkey").alias("train_samples"),
        history.alias("loss_history"),
        F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.lit(0.5)).alias("accuracy"),
    )
    names = ("final_loss", "epochs_per_sec", "samples_per_sec", "loss_per_sec", "accuracy_per_sec")
    return metrics.run_metrics(runs).select("id", "epochs_ran", *[_r(F.col(k)).alias(k) for k in names])


def newest_run(spark, sf_dir):
    out = metrics.newest(_runs(spark, sf_dir).select("run_key", "id", "final_loss"), "run_key", "id")
    return out.select("run_key", "id", _r(F.col("final_loss")).alias("final_loss"))


def interval_ema(spark, sf_dir):
    times = _table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.col("value").alias("dt"))
    return metrics.interval_ema(times, "worker", "seq", "dt").select("worker", _r(F.col("ema"), 4).alias("ema"))


def _pings(spark, sf_dir, nodes: int = 6) -> DataFrame:
    """Line items stand in for round trips between nodes."""
    a, b = F.col("l_suppkey") % nodes, F.col("l_partkey") % nodes
    return _table(spark, sf_dir, "lineitem").filter(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), (F.col("l_extendedprice") / 99991.0 + F.col("l_tax")).alias("rtt"))


def ping_stats(spark, sf_dir):
    out = metrics.ping_stats(_pings(spark, sf_dir))
    return out.select("src", "dst", *[_r(F.col(k)).alias(k) for k in ("min_rtt", "max_rtt", "avg_rtt")])


def server_choice(spark, sf_dir):
    nodes = spark.range(6).select(F.col("id").alias("node"))
    return metrics.server_choice(_pings(spark, sf_dir), nodes).select("s1", "s2", _r(F.col("worst")).alias("worst"))


def _worst(spark, sf_dir) -> list[tuple[int, int, float]]:
    """(node, node, largest round trip): a row for each pair of a few nodes."""
    return [(r["src"], r["dst"], r["max_rtt"]) for r in metrics.ping_stats(_pings(spark, sf_dir)).collect()]


def ring_order(spark, sf_dir):
    """Edges of the shortest cycle through all nodes."""
    ring = topology.ring_order(topology.Graph(6, _worst(spark, sf_dir)))
    edges = [(min(a, b), max(a, b)) for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True)]
    return spark.createDataFrame(edges, "a long, b long")


def node_roles(spark, sf_dir):
    """Two servers, and the workers with the edges of their ring."""
    servers, workers = topology.roles(6, 2, _worst(spark, sf_dir))
    edges = [(min(a, b), max(a, b)) for a, b in zip(workers, [*workers[1:], *workers[:1]], strict=True)]
    return spark.createDataFrame([("server", s, None) for s in servers] + [("ring", a, b) for a, b in edges], "role string, node long, next long")


# Sources: tables written in each format and read back


def _read_back(df: DataFrame) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return df.select("row_id", F.size("x").cast("long").alias("width"), _r(total, 4).alias("total"), _r(F.element_at("y", 1).cast("double")).alias("y"))


def text_source(spark, sf_dir):
    """Features as CSV with a header, labels as TSV, written in order of rows and paired by row number."""
    folder, rows = shared_folder(spark), _rows(spark, sf_dir).orderBy("row_id")
    rows.select(*[F.element_at("x", k + 1).alias(f"f{k}") for k in range(64)]).coalesce(1).write.csv(f"{folder}/x.csv", header=True)
    _table(spark, sf_dir, "embeddings").orderBy("vec_id").select(F.col("label").cast("float")).coalesce(1).write.csv(f"{folder}/y.tsv", sep="\t")
    return _read_back(local(spark, c.LocalDataset(f"{folder}/x.csv", f"{folder}/y.tsv", 64, 1)))


def packed_source(spark, sf_dir):
    """Features and labels as little-endian floats without a header, a file a task."""
    folder = shared_folder(spark)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array(F.col("label").cast("float")).alias("y")).repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id")

    def write(batches):
        for batch in batches:
            if batch.num_rows:
                for name, kind in (("embedding", "x"), ("y", "y")):
                    fs, root = filesystem(f"{folder}/{kind}")
                    fs.create_dir(root, recursive=True)
                    # Named by its first row, so that files by name are in order of rows.
                    with fs.open_output_stream(f"{root}/{batch.column(0)[0].as_py():012d}") as out:
                        out.write(batch.column(name).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.mapInArrow(write, "n long").collect()
    return _read_back(local(spark, c.LocalDataset(f"{folder}/x", f"{folder}/y", 64, 1)))


def idx_source(spark, sf_dir):
    """Embeddings as 8x8 images of 256 grey values with their labels, in IDX files."""
    folder = shared_folder(spark)
    grey = F.transform("embedding", lambda v: F.pmod(F.floor(F.abs(v.cast("double")) * 1000), F.lit(256)).cast("int"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("grey"), "label").repartition(1).sortWithinPartitions("vec_id")

    def write(batches):
        parts = [(b.column("grey").flatten().to_numpy().astype(np.uint8).tobytes(), b.column("label").to_numpy().astype(np.uint8).tobytes(), b.num_rows) for b in batches]
        n = sum(k for *_, k in parts)
        for at, name, head in ((0, "images", np.array([2051, n, 8, 8], ">i4")), (1, "labels", np.array([2049, n], ">i4"))):
            fs, root = filesystem(f"{folder}/{name}")
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/part") as out:
                out.write(head.tobytes() + b"".join(p[at] for p in parts))
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(write, "n long").collect()
    images, labels = idx_images(spark, f"{folder}/images"), idx_labels(spark, f"{folder}/labels")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * 255.0)
    return images.join(labels, "row_id").select("row_id", _r(total, 1).alias("grey"), F.col("label").cast("long").alias("label"))


def history_source(spark, sf_dir):
    """Records in two files of JSON lines, of which the second repeats some keys."""
    folder = shared_folder(spark)
    o = _table(spark, sf_dir, "orders").select(F.concat_ws("|", F.lit("s"), F.col("o_orderkey").cast("string")).alias("run_key"), "o_orderkey", (F.col("o_totalprice") / 7.0).alias("final_loss"))
    keyless = spark.createDataFrame([("no separator", 0, 0.0)], "run_key string, o_orderkey long, final_loss double")
    for name, rows in (("0", o.union(keyless)), ("1", o.filter(F.col("o_orderkey") % 4 == 0).withColumn("final_loss", -F.col("final_loss")))):
        rows.coalesce(1).write.json(f"{folder}/{name}")
        fs, root = filesystem(f"{folder}/{name}")
        part = next(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".json"))
        fs.create_dir(f"{root}/../all", recursive=True)
        fs.move(part, f"{root}/../all/{name}.jsonl")
    return history(spark, f"{folder}/all").select("run_key", _r(F.col("final_loss"), 4).alias("final_loss"))


def config_source(spark, sf_dir):
    """Layers of a model that went through its JSON form, with their parameters."""
    model = c.Sequential([c.Conv2d((1, 8, 8), (3, 1, 3), 1, 1, c.Kaiming(), c.ReLU(0.1)), c.MaxPooling((3, 8, 8), 2, 2), c.Dense(20, c.Uniform(-0.5, 0.5), c.Tanh(1.5)), c.Dense(10, c.Xavier(), c.Softmax())])
    back = c.model_from_json(json.dumps(model.to_json()))
    if back != model:
        raise ValueError("a model changed on its way through JSON")
    rows = [(k, x.key(), n, a, b) for k, (x, n, (a, b)) in enumerate(zip(back.layers, layer_params(back, 64), layer_sizes(back, 64), strict=True))]
    return spark.createDataFrame(rows, "layer long, kind string, parameters long, inputs long, outputs long")


# Vectors


def first_parameters(spark, sf_dir):
    """Draws of every initialiser for 100 inputs and 50 outputs against their limits, means and deviations."""
    n, rng = 40_000, np.random.default_rng(11)
    kinds = (c.Const(0.24), c.Uniform(-1.0, 3.0), c.UniformInclusive(-1.0, 3.0), c.Normal(2.0, 0.5), c.Kaiming(), c.Xavier(), c.Lecun(), c.XavierUniform(), c.LecunUniform())
    rows = []
    for kind in kinds:
        x = draw(kind, n, 100, 50, rng).astype(float)
        rows.append((kind.key(), n, round(float(x.mean()) * 50) / 50 + 0.0, round(float(x.std()) * 50) / 50, float(np.abs(x - x.mean()).max()) < 6 * float(x.std()) + 1e-9))
    given = draw(c.InlineParams((1.0, 2.0, 4.0)), 3, 1, 1, rng)
    return spark.createDataFrame([*rows, ("inline_params", 3, float(given.sum()), 0.0, True)], "kind string, n long, mean double, deviation double, bounded boolean")


def _pushes(spark, sf_dir) -> DataFrame:
    """(worker, pos, value): a gradient for each of 64 workers."""
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("worker"), F.col("event_id").alias("pos"), (F.col("value") - 50.0).cast("float").alias("value"))
    return e


def _sent(spark, sf_dir, keep_ratio: float | None) -> DataFrame:
    """Each worker's gradient as it arrives, and what stays with the worker."""

    def push(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        arrived, left = codec.send(table.column("value").to_numpy(), keep_ratio)
        return pa.table({"worker": table.column("worker"), "pos": table.column("pos"), "arrived": pa.array(arrived.astype(float)), "left": pa.array(left.astype(float))})

    return _pushes(spark, sf_dir).groupBy("worker").applyInArrow(push, "worker long, pos long, arrived double, left double")


def half_push(spark, sf_dir):
    return _sent(spark, sf_dir, None)


def sparse_push(spark, sf_dir):
    return _sent(spark, sf_dir, 0.3)


def _params(spark, sf_dir) -> tuple[DataFrame, Column, Column]:
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dim"), (F.col("o_totalprice") / 99991.0).alias("p"), (F.col("o_custkey") / 7.0).alias("g"))
    return o, F.col("p"), F.col("g")


def gd_step(spark, sf_dir):
    o, p, g = _params(spark, sf_dir)
    return o.select("dim", _r(vectors.gd_step(p, g, 0.03)).alias("p2"))


def momentum_step(spark, sf_dir):
    o, p, g = _params(spark, sf_dir)
    p2, v2 = vectors.momentum_step(p, g, p / 3.0, 0.03, 0.9)
    return o.select("dim", _r(p2).alias("p2"), _r(v2).alias("v2"))


def adam_step(spark, sf_dir):
    o, p, g = _params(spark, sf_dir)
    p2, v2, s2 = vectors.adam_step(p, g, p / 3.0, p * p, 3, 0.03)
    return o.select("dim", _r(p2).alias("p2"), _r(v2).alias("v2"), _r(s2, 4).alias("s2"))


def mean_gradient(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).alias("worker"), (F.col("l_partkey") % 1000).alias("dim"), (F.col("l_discount") / 7.0).alias("value"))
    return vectors.mean_gradient(items, 4).select("dim", _r(F.col("value")).alias("value"))


def _gradient(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("value") - 50.0).alias("value"))


def sparse_threshold(spark, sf_dir):
    return vectors.exact_threshold(_gradient(spark, sf_dir), 0.3).select(_r(F.col("threshold")).alias("threshold"))


def sparse_runs(spark, sf_dir):
    g = _gradient(spark, sf_dir)
    return vectors.kept_runs(g, vectors.exact_threshold(g, 0.3))


def layer_placement(spark, sf_dir):
    sizes = [layer_size for layer_size in (156, 0, 2416, 0, 48120, 10164, 850)]
    rows = [(s.layer, s.server, sizes[s.layer]) for s in placement(sizes, 2)]
    df = spark.createDataFrame(rows, "layer long, server long, size long")
    return partitioning.prefix_ranges(df, "server", "layer", "size").select("layer", "server", "start", "end")


# Training runs


def _dataset(spark, sf_dir) -> c.DataFrameDataset:
    return c.DataFrameDataset(_table(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id", 64, 10, 10)


def _losses(spark, model, training) -> DataFrame:
    return orchestrate(spark, model, training).wait().events


def _softmax_model() -> c.Sequential:
    return c.Sequential([c.Dense(10, c.Xavier(), c.Softmax())])


def local_sgd_allreduce(spark, sf_dir):
    """Softmax regression, four workers, averaged gradients: losses by round and worker."""
    t = c.all_reduce(4, _dataset(spark, sf_dir), c.GradientDescent(0.5), c.CrossEntropy(), 4, BATCH, seed=7)
    return _losses(spark, _softmax_model(), t).filter("kind = 'loss'").select("epoch", "worker", "loss")


def sparse_allreduce(spark, sf_dir):
    t = c.all_reduce(4, _dataset(spark, sf_dir), c.Adam(0.01), c.CrossEntropy(), 4, BATCH, serializer=c.SparseSerializer(0.2), offline_epochs=1, seed=7)
    return _losses(spark, _softmax_model(), t)


def ps_barrier(spark, sf_dir):
    t = c.parameter_server(5, 2, _dataset(spark, sf_dir), c.GradientDescentWithMomentum(0.3, 0.5), c.CrossEntropy(), c.BarrierSync(), c.BlockingStore(), 4, BATCH, seed=7)
    return _losses(spark, models.small_conv(), t)


def ps_async(spark, sf_dir):
    t = c.parameter_server(5, 1, _dataset(spark, sf_dir), c.GradientDescent(0.3), c.CrossEntropy(), c.NonBlockingSync(), c.WildStore(), 4, BATCH, seed=7)
    return _losses(spark, _softmax_model(), t)


def strategy_switch(spark, sf_dir):
    t = c.strategy_switch(5, 1, _dataset(spark, sf_dir), c.GradientDescent(0.01), c.CrossEntropy(), c.BarrierSync(), c.BlockingStore(), 8, BATCH, seed=7)
    return _losses(spark, _softmax_model(), t)


def model_weights(spark, sf_dir):
    t = c.all_reduce(4, _dataset(spark, sf_dir), c.GradientDescent(0.5), c.CrossEntropy(), 2, BATCH, seed=7)
    return orchestrate(spark, models.small_conv(), t).wait().weights()


# Runs that SQL can follow: given first parameters, and all rows of a worker in one batch, so that no order matters.


def _given_model() -> c.Sequential:
    """Softmax regression that starts from the weights of ``weight`` and biases of j / 7."""
    values = [((i * 7 + j * 3) % 11 - 5) / 50.0 for i in range(64) for j in range(10)] + [j / 7.0 for j in range(10)]
    return c.Sequential([c.Dense(10, c.InlineParams(tuple(values)), c.Softmax())])


def _whole(spark, sf_dir, make, *args, **more):
    """A run whose batches are as large as the dataset."""
    data = _dataset(spark, sf_dir)
    return orchestrate(spark, _given_model(), make(*args, dataset=data, loss_fn=c.CrossEntropy(), batch_size=data.df.count(), seed=7, **more)).wait()


def _rounds(spark, sf_dir):
    """Four workers, two rounds of two local epochs, averaged gradients."""
    return _whole(spark, sf_dir, c.all_reduce, 4, optimizer=c.GradientDescent(2.0), max_epochs=4, offline_epochs=1)


def _reported(model) -> DataFrame:
    return model.events.filter("kind = 'loss'").select(F.col("worker").cast("long").alias("worker"), F.col("epoch").cast("long").alias("epoch"), _r(F.col("loss"), 5).alias("loss"))


def _values(model) -> DataFrame:
    w = model.weights().select("name", F.posexplode("values").alias("at", "value"))
    return w.select("name", F.col("at").cast("long").alias("at"), _r(F.col("value").cast("double"), 3).alias("value"))


def allreduce_rounds(spark, sf_dir):
    return _reported(_rounds(spark, sf_dir))


def allreduce_weights(spark, sf_dir):
    return _values(_rounds(spark, sf_dir))


def adam_weights(spark, sf_dir):
    return _values(_whole(spark, sf_dir, c.all_reduce, 4, optimizer=c.Adam(0.05), max_epochs=2))


def server_rounds(spark, sf_dir):
    """Three workers, two servers, a barrier, averaged pushes, momentum; three rounds."""
    return _reported(_whole(spark, sf_dir, c.parameter_server, 5, 2, optimizer=c.GradientDescentWithMomentum(2.0, 0.5), sync=c.BarrierSync(), store=c.BlockingStore(), max_epochs=3))


def wild_rounds(spark, sf_dir):
    """Like ``server_rounds``, but each push is applied whole as it comes."""
    return _reported(_whole(spark, sf_dir, c.parameter_server, 5, 2, optimizer=c.GradientDescent(1.0), sync=c.BarrierSync(), store=c.WildStore(), max_epochs=2))


def early_stop(spark, sf_dir):
    """Stops at the third round, as all losses are within the tolerance."""
    model = _whole(spark, sf_dir, c.all_reduce, 3, optimizer=c.GradientDescent(0.5), max_epochs=12, early_stopping_tolerance=10.0)
    return model.events.select("kind", F.col("worker").cast("long").alias("worker"), F.col("epoch").cast("long").alias("epoch"), _r(F.col("loss"), 5).alias("loss"), "detail")


def predictions(spark, sf_dir):
    out = _rounds(spark, sf_dir).predict(_rows(spark, sf_dir))
    best = F.array_max(F.transform("prediction", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return out.select("row_id", best["i"].cast("long").alias("prediction"))


NAMES = (
    "partition_sizes batch_index redistribution vector_chunks shuffled_order one_hot_labels append_rows subset_rows row_slice "
    "dense_forward dense_join dense_backward softmax softmax_backward softmax_grad conv2d_pad1 conv2d_join max_pool_padded conv2d_gradient conv2d_input_delta max_pool max_pool_backward reshape_round_trip activations "
    "cross_entropy linreg_gradient argmax_accuracy loss_by_epoch mean_without_promoted convergence_epoch quiet_counts switch_epoch loss_admission loss_format worker_state event_union "
    "repeats_agg run_metrics newest_run interval_ema ping_stats server_choice gd_step momentum_step adam_step mean_gradient sparse_threshold sparse_runs layer_placement "
    "ring_order node_roles text_source packed_source idx_source history_source config_source first_parameters half_push sparse_push "
    "local_sgd_allreduce sparse_allreduce ps_barrier ps_async strategy_switch model_weights "
    "allreduce_rounds allreduce_weights adam_weights server_rounds wild_rounds early_stop predictions"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
