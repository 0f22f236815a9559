import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.functions import format_loss, normal_or_zero
from gradloom.kernels import codec, layers as kernels
from gradloom.operators import control, layers, metrics, partitioning, vectors


def traces(n=12, length=60):
    r = np.random.default_rng(3)
    return [(f"r{k}", e, float(v)) for k in range(n) for e, v in enumerate(np.abs(np.cumsum(r.normal(size=length) * (0.02 + 0.08 * k)) + 3))]


@pytest.fixture(scope="module")
def losses(spark):
    return spark.createDataFrame(traces(), "run string, epoch long, loss double")


def first(make):
    out = {}
    trackers = {}
    for run, epoch, loss in traces():
        if trackers.setdefault(run, make()).add(loss) and run not in out:
            out[run] = epoch
    return out


def test_trackers_agree_with_their_tables(losses):
    got = {r["run"]: r["epoch"] for r in control.convergence_epoch(losses, 0.15, by=("run",)).collect()}
    assert got == first(lambda: control.ConvergenceTracker(0.15)) and got
    got = {r["run"]: r["epoch"] for r in control.switch_epoch(losses, 0.03, by=("run",)).collect()}
    assert got == first(lambda: control.SwitchTracker(below=0.03)) and got


def test_quiet_counts_by_hand(spark):
    t, counts, fired, xs = control.ConvergenceTracker(1.0), [], [], (5, 5.5, 5.2, 9, 9.1, 9.2, 9.3)
    for x in xs:
        fired.append(t.add(x))
        counts.append(t.quiet)
    # The first loss counts, and 9, which breaks the count, is the first of the next.
    assert counts == [1, 2, 3, 1, 2, 3, 4] and fired.index(True) == 2
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(xs)], "run string, epoch long, loss double")
    assert [r["quiet"] for r in control.quiet_counts(df, 1.0, by=("run",)).orderBy("epoch").collect()] == counts


def test_equal_losses_converge_at_the_third(spark):
    t = control.ConvergenceTracker(0.0)
    assert [t.add(0.5) for _ in range(5)] == [False, False, True, True, True]
    df = spark.createDataFrame([("a", k, 0.5) for k in range(5)], "run string, epoch long, loss double")
    assert control.convergence_epoch(df, 0.0, by=("run",)).first()["epoch"] == 2


def test_admission_and_format(spark):
    df = spark.createDataFrame([(0.0,), (1e-310,), (float("nan"),), (float("inf"),), (-2.5,), (None,), (3e-5,)], "x double")
    assert sorted(r[0] for r in df.filter(normal_or_zero(F.col("x"))).collect()) == [-2.5, 0.0, 3e-5]
    got = {r["x"]: r["t"] for r in df.filter("x < 1").select("x", format_loss(F.col("x")).alias("t")).collect()}
    assert got[3e-5] == "3.000e-05" and got[-2.5] == "-2.50000000"


def long_images(spark, images):
    return spark.createDataFrame([(b, c * images.shape[2] * images.shape[3] + i * images.shape[3] + j, float(images[b, c, i, j])) for b, c, i, j in np.ndindex(images.shape)], "row long, i long, value double")


@pytest.mark.parametrize(("k", "stride", "padding"), [(2, 1, 0), (3, 1, 1), (3, 2, 1), (2, 2, 1)])
def test_convolution_in_long_form(spark, k, stride, padding):
    r = np.random.default_rng(k)
    x, w, b = r.normal(size=(2, 2, 5, 5)), r.normal(size=(3, 2, k, k)), r.normal(size=3)
    kernel = kernels.ConvKernel(3, 2, k, stride, padding)
    out = kernel.forward(np.concatenate([w.ravel(), b]), x)
    delta, grad = r.normal(size=out.shape), np.zeros(kernel.size)
    dx = kernel.backward(np.concatenate([w.ravel(), b]), grad, delta)
    image = long_images(spark, x)
    ks = spark.createDataFrame([(*map(int, i), float(w[i])) for i in np.ndindex(w.shape)], "f long, c long, kh int, kw int, value double")
    bias = spark.createDataFrame([(f, float(v)) for f, v in enumerate(b)], "f long, value double")
    d = spark.createDataFrame([(*map(int, i), float(delta[i])) for i in np.ndindex(delta.shape)], "row long, f long, oy long, ox long, value double")
    got = {tuple(r[:4]): r[4] for r in layers.conv2d(image, ks, bias, 5, 5, k, stride, padding).select("row", "f", "oy", "ox", "value").collect()}
    assert got == {tuple(i): pytest.approx(out[i]) for i in np.ndindex(out.shape)}
    to_k, to_b = layers.conv2d_gradients(image, d, 5, 5, k, stride, padding)
    got = {tuple(r[:4]): r[4] for r in to_k.select("f", "c", "kh", "kw", "value").collect()}
    assert got == {tuple(i): pytest.approx(grad[: w.size].reshape(w.shape)[i]) for i in np.ndindex(w.shape)}
    assert {r["f"]: r["value"] for r in to_b.collect()} == {f: pytest.approx(v) for f, v in enumerate(grad[w.size :])}
    got = {tuple(r[:4]): r[4] for r in layers.col2im(d, ks, 5, 5, stride, padding).select("row", "c", "r", "q", "value").collect()}
    for i in np.ndindex(dx.shape):
        assert got.get(tuple(i), 0.0) == pytest.approx(dx[i], abs=1e-9)


@pytest.mark.parametrize(("k", "stride", "padding"), [(2, 2, 0), (3, 2, 1)])
def test_pooling_in_long_form(spark, k, stride, padding):
    x = np.random.default_rng(k).normal(size=(2, 2, 6, 6))
    kernel = kernels.PoolKernel(k, stride, padding)
    out = kernel.forward(np.zeros(0), x)
    delta = np.random.default_rng(9).normal(size=out.shape)
    dx = kernel.backward(np.zeros(0), np.zeros(0), delta)
    pooled = layers.max_pool(long_images(spark, x), 6, 6, k, stride, padding)
    got = {tuple(r[:4]): r[4] for r in pooled.select("row", "c", "oy", "ox", "value").collect()}
    assert got == {tuple(i): pytest.approx(out[i]) for i in np.ndindex(out.shape)}
    d = spark.createDataFrame([(*map(int, i), float(delta[i])) for i in np.ndindex(delta.shape)], "row long, c long, oy long, ox long, value double")
    back = {tuple(r[:4]): r[4] for r in layers.max_pool_delta(pooled, d, k, stride, padding).select("row", "c", "r", "q", "value").collect()}
    for i in np.ndindex(dx.shape):
        assert back.get(tuple(i), 0.0) == pytest.approx(dx[i])


def test_sparse_threshold_and_runs(spark):
    r = np.random.default_rng(0)
    v = np.round(r.normal(size=3000), 3)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "pos long, value double").repartition(5)
    for ratio in (0.05, 0.3, 1.0):
        least = vectors.exact_threshold(df, ratio)
        want = max(np.sort(np.abs(v))[min(int(3000 * (1 - ratio)), 2999)], 2.0**-14)
        assert least.first()[0] == pytest.approx(want)
        runs = codec.runs(v, want)
        got = sorted((x["start"], x["length"], x["gap"]) for x in vectors.kept_runs(df, least).collect())
        assert [(a, n) for a, n, _ in got] == runs
        assert [g for *_, g in got] == [a - (runs[k - 1][0] + runs[k - 1][1] if k else 0) for k, (a, _) in enumerate(runs)]
    near = vectors.approximate_threshold(df, 0.3).first()[0]
    assert near == pytest.approx(np.quantile(np.abs(v), 0.7), rel=0.05)


def test_threshold_of_nothing(spark):
    empty = spark.createDataFrame([], "pos long, value double")
    assert vectors.kept_runs(empty, vectors.exact_threshold(empty, 0.5)).count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 4, 50, 230])
def test_ranges_are_in_order_whatever_their_number(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(k * 37 % 1009,) for k in range(1009)], "x long")
        rows = sorted(map(tuple, partitioning.in_ranges(df, "x").collect()))
        assert [r for _, r in rows] == sorted(r for _, r in rows) and rows[0][1] == 0
        assert len({r for _, r in rows}) >= 0.8 * partitions
        if partitions < 50:
            assert [r["rank"] for r in partitioning.numbered(df, "x").orderBy("x").collect()] == list(range(1009))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_redistribution_keeps_rows(spark):
    df = partitioning.partitioned(spark.range(23).withColumnRenamed("id", "row_id"), 5)
    out = partitioning.redistributed(df, [1], 5)
    assert out.count() == 23 and {r["worker"] for r in out.collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="no worker stays"):
        partitioning.redistributed(df, [0, 1, 2, 3, 4], 5)


def test_repeats(spark):
    rows = [("a", None, 1.0, [1.0], True), ("a", None, 3.0, [3.0], False), ("a", None, 2.2, [2.2], None), ("a", "x", 99.0, [9.0], True), ("b", None, None, None, None)]
    df = spark.createDataFrame(rows, "run_key string, error string, final_loss double, loss_history array<double>, switched boolean")
    out = {r["run_key"]: r for r in metrics.repeats(df).collect()}
    assert out["a"]["repeats"] == 3 and out["a"]["switched"] and out["a"]["loss_history"] == [2.2]
    assert out["a"]["final_loss"] == pytest.approx(np.mean([1, 3, 2.2])) and out["a"]["final_loss_std"] == pytest.approx(np.std([1, 3, 2.2]))
    assert out["b"]["final_loss"] is None and out["b"]["final_loss_std"] is None and out["b"]["switched"] is None
    failed = spark.createDataFrame([("c", 1, "late", 7.0, True), ("c", 0, "first", 5.0, False)], "run_key string, repeat int, error string, final_loss double, switched boolean")
    assert metrics.repeats(failed).select("final_loss", "error", "switched", "repeats", "final_loss_std").first() == (5.0, "first", False, None, None)


def test_ema(spark):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([100, 200, 50])], "w long, k long, ms double")
    want = 60_000.0
    for v in (100, 200, 50):
        want = want * 0.7 + v * 0.3
    assert metrics.interval_ema(df, "w", "k", "ms").first()["ema"] == pytest.approx(want)
