import numpy as np
import pytest

from gradloom import config as c
from gradloom.plans import initial, placement, topology, validate


def data(x=1, y=1, rows=4):
    return c.InlineDataset(tuple(range(x * rows)), tuple(range(y * rows)), x, y)


def run(**k):
    base = {"addrs": 2, "dataset": data(), "optimizer": c.GradientDescent(0.1), "loss_fn": c.Mse(), "max_epochs": 2, "batch_size": 2}
    return c.all_reduce(**base | k)


DENSE = c.Sequential([c.Dense(1)])


def test_valid_runs_pass():
    validate.validate(DENSE, run())


@pytest.mark.parametrize(
    ("model", "training", "says"),
    [
        (c.Sequential([]), run(), "at least one layer"),
        (c.Sequential([c.Dense(2)]), run(), "labels have 1"),
        (c.Sequential([c.Conv2d((1, 2, 2), (1, 1, 2))]), run(dataset=data(4)), "doesn't fit"),
        (c.Sequential([c.Conv2d((2, 3, 3), (1, 1, 2))]), run(dataset=data(18, 4)), "channels"),
        (c.Sequential([c.MaxPooling((1, 3, 3), 2, 1)]), run(dataset=data(8, 4)), "takes 9"),
        (DENSE, run(batch_size=5), "larger than the dataset"),
        (DENSE, run(addrs=0), "one node"),
        (DENSE, run(dataset=c.InlineDataset((1, 2, 3), (1,), 2, 1)), "can't be cut"),
        (DENSE, run(dataset=c.InlineDataset((1, 2, 3), (1,), 1, 1)), "different row counts"),
        (DENSE, run(dataset=c.InlineDataset((), (), 1, 1)), "no rows"),
    ],
)
def test_invalid_runs_fail(model, training, says):
    with pytest.raises(c.ConfigError, match=says):
        validate.validate(model, training)


def test_servers_leave_workers():
    t = c.parameter_server(2, 2, data(), c.GradientDescent(0.1), c.Mse(), c.BarrierSync(), c.BlockingStore(), 1, 1)
    with pytest.raises(c.ConfigError, match="no worker"):
        validate.validate_training(t)


@pytest.mark.parametrize(
    "make",
    [
        lambda: c.GradientDescent(0),
        lambda: c.GradientDescent(float("nan")),
        lambda: c.GradientDescentWithMomentum(0.1, 1.5),
        lambda: c.Adam(0.1, eps=0),
        lambda: c.ReLU(-0.1),
        lambda: c.SparseSerializer(2),
        lambda: c.Dense(0),
        lambda: c.Uniform(1, 1),
        lambda: c.Normal(0, -1),
        lambda: c.EarlyStopping(-1),
        lambda: run(early_stopping_tolerance=0),
        lambda: run(max_epochs=0),
        lambda: c.ParameterServer(0),
    ],
)
def test_ranges(make):
    with pytest.raises(c.ConfigError):
        make()


def test_json_round_trip():
    text = """{"layers": [{"conv": {"input_dim": [1, 8, 8], "kernel_dim": [2, 1, 3], "stride": 1, "padding": 1, "init": {"uniform": {"low": -1, "high": 1}}, "act_fn": {"relu": {"slope": 0.1}}}},
        {"max_pooling": {"input_dim": [2, 8, 8], "filter_size": 2, "stride": 2, "padding": 0}}, {"dense": {"output_size": 4, "init": "kaiming", "act_fn": "softmax"}}]}"""
    model = c.model_from_json(text)
    assert model.layers[0] == c.Conv2d((1, 8, 8), (2, 1, 3), 1, 1, c.Uniform(-1, 1), c.ReLU(0.1))
    assert model.layers[2] == c.Dense(4, c.Kaiming(), c.Softmax())
    import json

    assert c.model_from_json(json.dumps(model.to_json())) == model


def training_json(algorithm, **more):
    import json

    base = {
        "addrs": ["a:1", "b:1", "c:1"],
        "algorithm": algorithm,
        "dataset": {"src": {"inline": {"samples": [1, 2, 3, 4], "labels": [2, 4, 6, 8]}}, "x_size": 1, "y_size": 1},
        "optimizer": {"adam": {"lr": 0.001, "b1": 0.9, "b2": 0.999, "eps": 1e-8}},
        "loss_fn": "cross_entropy",
        "batch_size": 4,
        "max_epochs": 5,
        "offline_epochs": 1,
    }
    return c.training_from_json(json.dumps(base | more))


def test_training_json():
    t = training_json({"strategy_switch": {"nservers": 1, "synchronizer": "non_blocking", "store": "wild"}}, serializer={"sparse_capable": {"r": 0.5}}, early_stopping={"tolerance": 0.1}, seed=3)
    assert t.algorithm == c.StrategySwitch(1, c.NonBlockingSync(), c.WildStore()) and t.n_workers == 3 and t.n_servers == 1
    assert t.serializer.keep_ratio == 0.5 and t.early_stopping.tolerance == 0.1 and t.seed == 3 and t.optimizer == c.Adam(0.001)
    assert training_json("all_reduce").algorithm == c.AllReduce()
    assert training_json({"parameter_server": {"nservers": 1, "synchronizer": "barrier", "store": "blocking"}}).n_workers == 2


@pytest.mark.parametrize("bad", ["nothing", {"parameter_server": {"servers": 1}}, {"a": 1, "b": 2}, {"parameter_server": {}}])
def test_unknown_json(bad):
    with pytest.raises(c.ConfigError):
        training_json(bad)


def test_losses_on_the_wire():
    assert c.loss_to_wire(float("nan")) is None and np.isnan(c.loss_from_wire(None)) and c.loss_from_wire(0.5) == 0.5


# Initial parameters


@pytest.mark.parametrize(
    ("init", "deviation"),
    [
        (c.Kaiming(), (2 / 50) ** 0.5),
        (c.Xavier(), (2 / 80) ** 0.5),
        (c.Lecun(), (1 / 50) ** 0.5),
        (c.XavierUniform(), (6 / 80) ** 0.5 / 3**0.5),
        (c.LecunUniform(), (3 / 50) ** 0.5 / 3**0.5),
        (c.Normal(0, 0.3), 0.3),
        (c.Uniform(-1, 1), 1 / 3**0.5),
        (c.UniformInclusive(-1, 1), 1 / 3**0.5),
    ],
)
def test_initial_distributions(init, deviation):
    out = initial.draw(init, 40_000, 50, 30, np.random.default_rng(0))
    assert out.std() == pytest.approx(deviation, rel=0.03) and abs(out.mean()) < 0.02


def test_initial_params():
    model = c.Sequential([c.Dense(5, c.Const(0.0)), c.Dense(1, c.Const(1.0))])
    assert initial.initial_params(model, 0 + 1, 1).tolist() == [0.0] * 10 + [1.0] * 6
    given = c.Sequential([c.Dense(1, c.InlineParams((1.0, 2.0, 3.0)))])
    assert initial.initial_params(given, 2, 1).tolist() == [1, 2, 3]
    with pytest.raises(c.ConfigError):
        initial.initial_params(given, 3, 1)
    deep = c.Sequential([c.Dense(5), c.Dense(1)])
    assert (initial.initial_params(deep, 4, 1) == initial.initial_params(deep, 4, 1)).all()
    assert initial.resolve_seed(4) == 4 and isinstance(initial.resolve_seed(None), int)


# Placement


def test_placement():
    assert placement.balanced([3, 5, 2, 4], 2) == [1, 0, 0, 1]
    sizes = [156, 0, 2416, 0, 48_120]
    slots = placement.placement(sizes, 2)
    v = np.arange(sum(sizes), dtype=np.float32)
    assert (placement.gather(placement.scatter(v, sizes, slots), slots) == v).all()
    assert placement.contiguous(7, 3) == [(0, 3), (3, 5), (5, 7)]
    assert placement.shards(100, 4) == (8, 13) and placement.shards(3, 4) == (3, 1)


def test_worker_optimiser():
    args = (data(), c.Adam(0.2), c.Mse(), c.BarrierSync(), c.BlockingStore(), 1, 1)
    assert placement.worker_optimiser(c.parameter_server(3, 1, *args)) == c.GradientDescent(0.2)
    assert placement.worker_optimiser(c.strategy_switch(3, 1, *args)) == c.Adam(0.2)


# Topology


def test_centres():
    assert topology.central_vertices(topology.Graph(3, [(0, 1, 5), (0, 2, 2), (1, 2, 2)]), 2) == [0, 1]
    with pytest.raises(ValueError, match="leaves a graph"):
        topology.Graph(2, [(0, 2, 1)])


def test_rings():
    from itertools import permutations

    r = np.random.default_rng(5)
    edges = [(a, b, float(r.integers(1, 50))) for a in range(6) for b in range(a)]
    w = {frozenset(e[:2]): e[2] for e in edges}
    cost = lambda p: sum(w[frozenset((a, b))] for a, b in zip(p, (*p[1:], p[0]), strict=True))
    ring = topology.ring_order(topology.Graph(6, edges))
    assert ring[0] == 0 and sorted(ring) == list(range(6)) and cost(ring) == min(cost((0, *p)) for p in permutations(range(1, 6)))
    assert topology.ring_order(topology.Graph(1, [])) == [0] and topology.ring_order(topology.Graph(3, [(0, 1, 1)])) == []
    assert topology.ring_order(topology.Graph(2, [(0, 1, 1)])) == [0, 1]


def test_roles():
    assert topology.roles(4, 1, []) == ([0], [1, 2, 3])
    far = [(a, b, 10.0 if 2 not in (a, b) else 1.0) for a in range(4) for b in range(a)]
    servers, workers = topology.roles(4, 1, far)
    assert servers == [2] and sorted(workers) == [0, 1, 3]
