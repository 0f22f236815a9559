import json

import numpy as np
import pytest

import gradloom as g
from gradloom import config as c
from gradloom import __main__ as command
from gradloom import session
from gradloom.kernels.training import loss_of, run_epoch
from gradloom.operators.partitioning import partitioned
from gradloom.plans.initial import initial_params
from gradloom.plans.lowering import network
from gradloom.plans.placement import contiguous
from gradloom.session import EARLY, MANUAL, MAX_EPOCHS, TrainingError, orchestrate
from gradloom.sinks.model import read_safetensors
from gradloom.sources.tables import load
from gradloom.strategies import ParameterServerRun


@pytest.fixture(scope="module")
def teacher():
    """Labels planted by a fixed linear map; the last rows are held out."""
    r = np.random.default_rng(0)
    x = r.normal(size=(1200, 8)).astype(np.float32)
    y = np.eye(3, dtype=np.float32)[np.argmax(x @ r.normal(size=(8, 3)), axis=1)]
    make = lambda a, b: c.InlineDataset(tuple(x[a:b].ravel().tolist()), tuple(y[a:b].ravel().tolist()), 8, 3)
    return make(0, 1000), make(1000, 1200)


MODEL = g.Sequential([g.Dense(3, g.Xavier(), g.Softmax())])
COMMON = {"optimizer": g.GradientDescent(1.0), "loss_fn": g.CrossEntropy(), "max_epochs": 8, "batch_size": 25, "seed": 5}


def train(spark, training, model=MODEL):
    return g.orchestrate(spark, model, training).wait()


@pytest.mark.parametrize("serializer", [None, g.SparseSerializer(0.3)])
def test_all_reduce_learns(spark, teacher, serializer):
    data, held = teacher
    out = train(spark, g.all_reduce(3, data, serializer=serializer, **COMMON))
    assert out.stop_reason == MAX_EPOCHS and len(out.loss_history()) == 8
    assert out.loss_history()[-1] < 0.5 * out.loss_history()[0]
    assert out.accuracy(load(spark, held)) > 0.85


def test_all_reduce_is_federated_averaging(spark, teacher):
    """Under plain gradient descent a round moves to the mean of the workers' own ends (but for half precision)."""
    data, _ = teacher
    out = train(spark, g.all_reduce(4, data, **COMMON | {"max_epochs": 1}, shuffle=False))
    x, y = np.array(data.samples, np.float32).reshape(-1, 8), np.array(data.labels, np.float32).reshape(-1, 3)
    net, start = network(MODEL, 8), initial_params(MODEL, 8, 5)
    ends = []
    for a, b in contiguous(1000, 4):
        own = start.copy()
        run_epoch(net, own, x[a:b], y[a:b], loss_of(g.CrossEntropy()), 25, 1.0, np.zeros(net.size, np.float32))
        ends.append(own)
    assert out.params == pytest.approx(np.mean(ends, axis=0), abs=2e-3)


@pytest.mark.parametrize("sync", [g.BarrierSync(), g.NonBlockingSync()])
@pytest.mark.parametrize("store", [g.BlockingStore(), g.WildStore()])
def test_parameter_server_learns(spark, teacher, sync, store):
    data, held = teacher
    t = g.parameter_server(4, 1, data, sync=sync, store=store, **COMMON | {"optimizer": g.GradientDescent(0.3)})
    out = train(spark, t)
    assert out.accuracy(load(spark, held)) > 0.75
    assert out.params.tolist() == train(spark, t).params.tolist()
    pushes = out.events.filter("kind = 'push'").collect()
    assert len(pushes) == (0 if isinstance(sync, g.BarrierSync) else 24)


def test_barrier_equals_all_reduce(spark, teacher):
    data, _ = teacher
    a = train(spark, g.all_reduce(3, data, **COMMON | {"optimizer": g.GradientDescentWithMomentum(0.5, 0.5)}))
    two = g.Sequential([g.Dense(3, g.Xavier(), g.Softmax())])
    b = train(spark, g.parameter_server(5, 2, data, sync=g.BarrierSync(), store=g.BlockingStore(), **COMMON | {"optimizer": g.GradientDescentWithMomentum(0.5, 0.5)}), two)
    assert a.params == pytest.approx(b.params, abs=1e-6)


def test_stores_by_hand():
    one = lambda store, sync: ParameterServerRun(np.zeros(2, np.float32), 2, None, kind=c.ParameterServer(1, sync, store), sizes=[2], optimizer=c.GradientDescent(1.0))
    results = {0: ([0.0], np.array([2, 4], np.float32)), 1: ([0.0], np.array([4, 8], np.float32))}
    mean, wild, late = one(c.BlockingStore(), c.BarrierSync()), one(c.WildStore(), c.BarrierSync()), one(c.BlockingStore(), c.NonBlockingSync())
    for s in (mean, wild, late):
        events = s.finish_round(results, 0)
    assert mean.params.tolist() == [-3, -6] and wild.params.tolist() == [-6, -12] and late.params.tolist() == [-3, -6]
    assert [e["detail"] for e in events] == ["staleness=0", "staleness=1"]
    assert late.start_params().tolist() == [[-1, -2], [-3, -6]]


def test_switch(spark, teacher):
    data, _ = teacher
    t = g.strategy_switch(4, 1, data, sync=g.BarrierSync(), store=g.BlockingStore(), **COMMON | {"optimizer": g.GradientDescent(1e-4), "max_epochs": 9})
    out = train(spark, t)
    kinds = {r["kind"]: r for r in out.events.collect()}
    assert out.switched and kinds["switch"]["epoch"] == 6 and kinds["became_server"]["worker"] == 0
    by_epoch = {r["epoch"]: r["count"] for r in out.events.filter("kind = 'loss'").groupBy("epoch").count().collect()}
    assert by_epoch == {**dict.fromkeys(range(6), 4), **dict.fromkeys(range(6, 9), 3)}


def test_early_stop_and_offline_epochs(spark, teacher):
    data, _ = teacher
    out = train(spark, g.all_reduce(3, data, early_stopping_tolerance=0.5, offline_epochs=1, **COMMON | {"max_epochs": 20}))
    assert out.stop_reason == EARLY and len(out.loss_history()) == 8


def test_manual_stop_and_single_use(spark, teacher):
    data, _ = teacher
    seen = []
    session = g.orchestrate(spark, MODEL, g.all_reduce(2, data, **COMMON), on_epoch=lambda e, loss: (seen.append(e), e == 2 and session.stop()))
    out = session.wait()
    assert out.stop_reason == MANUAL and seen == [0, 1, 2]
    with pytest.raises(TrainingError):
        session.wait()


def test_diverging_run_fails(spark, teacher):
    data, _ = teacher
    with pytest.raises(TrainingError, match="loss"), np.errstate(all="ignore"):
        train(spark, g.all_reduce(2, data, **COMMON | {"optimizer": g.GradientDescent(1e30), "loss_fn": g.Mse()}), g.Sequential([g.Dense(3), g.Dense(3)]))


def test_one_worker_and_too_many(spark, teacher):
    data, _ = teacher
    assert train(spark, g.all_reduce(1, data, **COMMON | {"max_epochs": 1})).stop_reason == MAX_EPOCHS
    with pytest.raises(c.ConfigError, match="can't be shared"):
        g.orchestrate(spark, MODEL, g.all_reduce(2000, data, **COMMON))


def test_partitions_by_arithmetic_and_by_rank_agree(spark):
    for n, workers in ((10, 3), (7, 7), (3, 5), (100, 11)):
        df = spark.range(n).withColumnRenamed("id", "row_id")
        a = {r["row_id"]: r["worker"] for r in partitioned(df, workers, n).collect()}
        assert a == {r["row_id"]: r["worker"] for r in partitioned(df, workers).collect()}
        assert [sum(w == k for w in a.values()) for k in range(workers)] == [b - x for x, b in contiguous(n, workers)]


def test_model_files(spark, teacher, tmp_path):
    data, held = teacher
    out = train(spark, g.all_reduce(2, data, **COMMON | {"max_epochs": 1}))
    out.save_safetensors(str(tmp_path / "m.safetensors"))
    out.save_parquet(str(tmp_path / "p"))
    assert (tmp_path / "m.safetensors").stat().st_size > 0 and spark.read.parquet(str(tmp_path / "p")).count() == 2
    df = load(spark, held)
    p = out.predict(df)
    assert p.columns == [*df.columns, "prediction"] and p.count() == 200
    assert 0 <= out.accuracy(df, last_on_ties=False) <= 1


def test_stream_control(spark, tmp_path):
    from gradloom.operators.control import ConvergenceTracker
    from gradloom.streaming import converged_runs, running_loss

    r = np.random.default_rng(0)
    traces = {f"r{k}": np.cumsum(r.normal(size=40) * (0.3 + k)).tolist() for k in range(4)}
    rows = [(run, e, loss) for run, t in traces.items() for e, loss in enumerate(t)]
    spark.createDataFrame(rows, "run string, epoch long, loss double").repartition(1).sortWithinPartitions("epoch").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, epoch long, loss double").parquet(str(tmp_path / "in"))
    query = converged_runs(stream, 0.4).writeStream.format("memory").queryName("converged").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {}
    for run, t in traces.items():
        tracker = ConvergenceTracker(0.4)
        hit = next((e for e, loss in enumerate(t) if tracker.add(loss)), None)
        if hit is not None:
            want[run] = hit
    assert {x["run"]: x["epoch"] for x in spark.table("converged").collect()} == want and want
    batch = spark.createDataFrame(rows, "run string, epoch long, loss double").selectExpr("run", "loss", "timestamp_seconds(epoch * 60) AS ts")
    got = running_loss(batch).collect()
    assert sum(x["n"] for x in got) == 160 and len(got) == 16


def test_mean_by_parts_is_the_collected_one(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=8).tolist(), np.eye(3)[k % 3].tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "row_id long, x array<float>, y array<float>")
    model = c.Sequential([c.Dense(7, c.Xavier(), c.Tanh()), c.Dense(3, c.Xavier(), c.Softmax())])
    data = c.DataFrameDataset(df, x_size=8, y_size=3)
    runs = (
        c.all_reduce(3, data, c.Adam(0.05), c.CrossEntropy(), 4, 8, seed=3, offline_epochs=1),
        c.parameter_server(5, 2, data, c.GradientDescentWithMomentum(0.1, 0.5), c.CrossEntropy(), c.BarrierSync(), c.BlockingStore(), 3, 8, seed=3),
        # Each worker starts from what it pulled, which goes by files when it is large.
        c.parameter_server(5, 2, data, c.GradientDescent(0.1), c.CrossEntropy(), c.NonBlockingSync(), c.WildStore(), 3, 8, seed=3),
    )
    for t in runs:
        one = orchestrate(spark, model, t).wait()
        with monkeypatch.context() as m:
            m.setattr(session, "COLLECTED_BYTES", 0)
            m.setattr(session, "PART_VALUES", 10)
            two = orchestrate(spark, model, t).wait()
        assert np.array_equal(one.params, two.params) and one.history == two.history
        assert one.events.collect() == two.events.collect()


def test_command_line_saves_each_run(spark, tmp_path):
    model = {"layers": [{"dense": {"output_size": 1, "init": "xavier"}}]}
    training = {
        "addrs": ["a", "b"],
        "algorithm": "all_reduce",
        "dataset": {"src": {"inline": {"samples": [0, 1, 2, 3], "labels": [1, 2, 3, 4]}}, "x_size": 1, "y_size": 1},
        "optimizer": {"gradient_descent": {"lr": 0.1}},
        "loss_fn": "mse",
        "batch_size": 2,
        "max_epochs": 2,
        "seed": 4,
    }
    for name, value in (("m", model), ("t", training)):
        (tmp_path / name).write_text(json.dumps(value))
    args = [str(tmp_path / "m"), str(tmp_path / "t"), "--save-dir", str(tmp_path / "out")]
    one, two = command.main(args, spark), command.main(args, spark)
    assert one != two and all("seed4" in p for p in (one, two))
    first, second = read_safetensors(one), read_safetensors(two)
    assert first["layer_0.weight"].shape == (1, 1) and all(np.array_equal(first[k], second[k]) for k in first)
