import numpy as np
import pytest

from gradloom import config as c
from gradloom.kernels import codec, layers, training
from gradloom.models import lenet5, nielsen, small_conv
from gradloom.plans.initial import initial_params
from gradloom.plans.lowering import kernels, layer_params, network


def forward(kernel, params, x):
    return kernel.forward(np.array(params, np.float64), np.array(x, np.float64))


def test_dense_forward():
    out = forward(layers.DenseKernel(3, 2), [1, 2, 3, 4, 5, 6, 7, 8], [[9, 10, 11]])
    assert out.tolist() == [[101, 132]]


IMAGE = np.arange(1, 10).reshape(1, 1, 3, 3)


def test_conv_forward():
    assert forward(layers.ConvKernel(1, 1, 2), [1, 2, 3, 4, 5], IMAGE)[0, 0].tolist() == [[42, 52], [72, 82]]
    padded = forward(layers.ConvKernel(1, 1, 2, 1, 1), [1, 2, 3, 4, 5], IMAGE)[0, 0].tolist()
    assert padded == [[9, 16, 23, 14], [23, 42, 52, 26], [41, 72, 82, 38], [19, 28, 31, 14]]
    assert forward(layers.ConvKernel(1, 1, 3, 2, 1), np.zeros(10), np.zeros((1, 1, 8, 8))).shape == (1, 1, 4, 4)


def test_conv_backward():
    k, grad = layers.ConvKernel(1, 1, 2, 2), np.zeros(5)
    params = np.array([1, 2, 3, 4, 5.0])
    k.forward(params, np.arange(1, 17.0).reshape(1, 1, 4, 4))
    dx = k.backward(params, grad, np.array([[[[17, 18], [19, 20.0]]]]))
    assert dx[0, 0].tolist() == [[17, 34, 18, 36], [51, 68, 54, 72], [19, 38, 20, 40], [57, 76, 60, 80]]
    assert grad.tolist() == [462, 536, 758, 832, 74]


def test_pool():
    k = layers.PoolKernel(2, 2)
    x = np.arange(1, 17.0).reshape(1, 1, 4, 4)
    out = k.forward(np.zeros(0), x)
    assert out[0, 0].tolist() == [[6, 8], [14, 16]]
    back = k.backward(np.zeros(0), np.zeros(0), out)[0, 0]
    assert {(i, j): back[i, j] for i, j in zip(*np.nonzero(back), strict=True)} == {(1, 1): 6, (1, 3): 8, (3, 1): 14, (3, 3): 16}
    p = layers.PoolKernel(2, 2, 1)
    p.forward(np.zeros(0), x)
    assert p.backward(np.zeros(0), np.zeros(0), np.arange(1, 10.0).reshape(1, 1, 3, 3))[0, 0].tolist() == [[1, 0, 2, 3], [0, 0, 0, 0], [4, 0, 5, 6], [7, 0, 8, 9]]


def test_pool_takes_the_last_of_equal_maxima():
    k = layers.PoolKernel(2, 2)
    k.forward(np.zeros(0), np.ones((1, 1, 2, 2)))
    assert k.backward(np.zeros(0), np.zeros(0), np.array([[[[5.0]]]]))[0, 0].tolist() == [[0, 0], [0, 5]]


def test_reshapes():
    k = layers.ToImage(1, 2, 2)
    x = np.arange(1, 13.0).reshape(3, 4)
    assert k.forward(None, x).shape == (3, 1, 2, 2) and (layers.ToFlat(1, 2, 2).forward(None, k.forward(None, x)) == x).all()
    with pytest.raises(layers.ShapeError):
        k.forward(None, x[:, :3])
    with pytest.raises(layers.ShapeError):
        layers.DenseKernel(3, 2).forward(np.zeros(8), np.zeros((1, 1, 1, 3)))


@pytest.mark.parametrize(
    "kernel",
    [
        layers.DenseKernel(12, 5),
        *[layers.ConvKernel(3, 2, k, s, p) for k, s, p in ((2, 1, 0), (3, 1, 1), (2, 2, 1), (3, 2, 2))],
        *[layers.PoolKernel(k, s, p) for k, s, p in ((2, 2, 0), (2, 1, 1), (3, 2, 1))],
        layers.SigmoidKernel(2.0),
        layers.TanhKernel(1.5),
        layers.ReLUKernel(0.1),
        layers.ReLUKernel(0.0),
        layers.SoftmaxKernel(),
    ],
    ids=str,
)
def test_gradients_by_finite_differences(kernel):
    r = np.random.default_rng(1)
    image = isinstance(kernel, layers.ConvKernel | layers.PoolKernel)
    x = r.normal(size=(2, 2, 5, 5) if image else (3, 12))
    params = r.normal(size=kernel.size)
    out = kernel.forward(params, x)
    w = r.normal(size=out.shape)
    grad = np.zeros(kernel.size)
    dx = kernel.backward(params, grad, w.copy())
    f = lambda p, v: float((kernel.forward(p, v) * w).sum())
    h = 1e-6
    for flat, got in ((x, dx), (params, grad)):
        for k in range(0, flat.size, max(1, flat.size // 25)):
            step = np.zeros(flat.size)
            step[k] = h
            step = step.reshape(flat.shape)
            a, b = ((f(params, x + step), f(params, x - step)) if flat is x else (f(params + step, x), f(params - step, x)))
            assert (a - b) / (2 * h) == pytest.approx(got.ravel()[k], abs=1e-5)


@pytest.mark.parametrize("loss", [training.mse, training.cross_entropy])
def test_loss_gradients(loss):
    r = np.random.default_rng(2)
    p, y = r.random((4, 3)) + 0.1, np.eye(3)[r.integers(0, 3, 4)]
    _, grad = loss(p, y)
    for k in range(p.size):
        step = np.zeros(p.size)
        step[k] = 1e-6
        step = step.reshape(p.shape)
        assert (loss(p + step, y)[0] - loss(p - step, y)[0]) / 2e-6 == pytest.approx(grad.ravel()[k], abs=1e-6)


def test_loss_scale():
    p, y = np.full((2, 10), 0.1), np.eye(10)[[1, 2]]
    assert training.cross_entropy(p, y)[0] == pytest.approx(np.log(10) / 10)
    assert training.cross_entropy(p, y, "mean_rows")[0] == pytest.approx(np.log(10))
    assert training.cross_entropy(np.zeros((1, 2)), np.array([[1.0, 0]]))[0] == pytest.approx(-np.log(training.F32_EPS) / 2)
    assert training.mse(np.array([[1.0, 3]]), np.array([[0.0, 1]]))[0] == 2.5


def test_optimisers():
    g = np.array([1.0, -2.0], np.float32)
    p = np.zeros(2, np.float32)
    training.Optimiser(c.GradientDescent(0.5), 2).step(p, g)
    assert p.tolist() == [-0.5, 1.0]
    p, o = np.zeros(2, np.float32), training.Optimiser(c.GradientDescentWithMomentum(0.5, 0.5), 2)
    o.step(p, g)
    o.step(p, g)
    assert p.tolist() == [-1.25, 2.5]
    p, o = np.zeros(2, np.float32), training.Optimiser(c.Adam(0.1), 2)
    for t in range(1, 4):
        o.step(p, g)
        assert p == pytest.approx([-0.1 * t, 0.1 * t], abs=1e-4)


def test_batches_and_epochs():
    assert [(s.start, s.stop) for s in training.batches(5, 2)] == [(0, 2), (2, 4), (4, 5)]
    assert list(training.batches(0, 2)) == []
    net = network(c.Sequential([c.Dense(1)]), 2)
    with pytest.raises(training.EmptyEpoch):
        training.run_epoch(net, np.zeros(3, np.float32), np.zeros((0, 2)), np.zeros((0, 1)), training.mse, 2, 0.1, np.zeros(3, np.float32))
    assert sorted(training.epoch_order(9, 1, 0, 0)) == list(range(9))
    assert training.epoch_order(9, 1, 0, 0).tolist() == training.epoch_order(9, 1, 0, 0).tolist() != training.epoch_order(9, 1, 1, 0).tolist()


def test_residual_is_the_sum_along_the_path():
    r = np.random.default_rng(0)
    net = network(c.Sequential([c.Dense(2)]), 3)
    x, y = r.normal(size=(7, 3)).astype(np.float32), r.normal(size=(7, 2)).astype(np.float32)
    start = r.normal(size=net.size).astype(np.float32)
    losses, residual = training.local_training(net, start, x, y, training.mse, 3, 0.1, 2, None, 0, 0)
    own = start.copy()
    total = np.zeros(net.size, np.float32)
    for _ in range(2):
        training.run_epoch(net, own, x, y, training.mse, 3, 0.1, total)
    # Under plain gradient descent the path ends at start - lr * residual.
    assert len(losses) == 2 and own == pytest.approx(start - 0.1 * residual, abs=1e-5)


# Codec


def test_sparse_bytes():
    body = codec.encode_sparse(np.array([1, -1, 0, 2], np.float32), 1)
    assert len(body) == 30 and codec.decode_sparse(body).tolist() == [1, -1, 0, 2]
    assert codec.runs(np.array([1, -1, 0, 2], np.float32), 1) == [(0, 2), (3, 1)]


@pytest.mark.parametrize("body", [b"", b"\x01", codec.encode_sparse(np.ones(3, np.float32), 1)[:-1], codec.encode_sparse(np.ones(3, np.float32), 1)[:12]])
def test_bad_bytes(body):
    with pytest.raises(codec.CodecError):
        codec.decode_sparse(body)


def test_threshold_keeps_the_ratio():
    v = np.arange(16, dtype=np.float32)
    least = codec.threshold(v, 0.4)
    assert [x for x in v.tolist() if x >= least] == list(range(9, 16))
    assert codec.threshold(np.zeros(4, np.float32), 0.5) == codec.LEAST_THRESHOLD


def test_error_feedback():
    v = np.array([0.5] * 50 + [0.001] * 50 + [4.0] * 50 + [0.002] * 50, np.float32)
    arrived, left = codec.send(v, 0.25)
    assert (arrived != 0).sum() == 50 and arrived + left == pytest.approx(v)
    arrived, left = codec.send(v, None)
    assert not left.any() and arrived == pytest.approx(v, rel=1e-3)
    assert codec.compress(np.ones(4, np.float32), 1.0)[1] is False
    assert codec.half(np.array([1 / 3], np.float32))[0] == np.float32(np.float16(1 / 3))


# Models


def test_ready_made_models():
    assert sum(layer_params(lenet5(), 784)) == 61_706
    for model in (lenet5(), nielsen(), nielsen(20)):
        net = network(model, 784)
        out = net.forward(initial_params(model, 784, 1), np.random.default_rng(0).random((2, 784)).astype(np.float32))
        assert out.shape == (2, 10) and out.sum(axis=1) == pytest.approx([1, 1], abs=1e-5)


def test_lowering_inserts_reshapes():
    kinds = [type(k).__name__ for _, k in kernels(small_conv(), 64)]
    assert kinds == ["ToImage", "ConvKernel", "ReLUKernel", "PoolKernel", "ToFlat", "DenseKernel", "ReLUKernel", "DenseKernel", "SoftmaxKernel"]


SYMBOLS = np.array([[0, 1, 0, 1, 1, 1, 0, 1, 0], [0, 0, 0, 0, 1, 0, 0, 0, 0], [1, 0, 1, 0, 1, 0, 1, 0, 1], [1, 1, 1, 1, 0, 1, 1, 1, 1]], np.float32)


@pytest.mark.parametrize(
    ("x", "y", "model", "lr", "bound"),
    [
        ([[0], [1], [2], [3]], [[1], [2], [3], [4]], [c.Dense(1)], 0.1, 1e-3),
        ([[0, 0], [0, 1], [1, 0], [1, 1]], [[0], [0], [0], [1]], [c.Dense(1, c.Xavier(), c.Sigmoid())], 5.0, 0.02),
        ([[0, 0], [0, 1], [1, 0], [1, 1]], [[0], [1], [1], [0]], [c.Dense(4, c.Xavier(), c.Tanh()), c.Dense(1, c.Xavier(), c.Sigmoid())], 2.0, 0.02),
        (SYMBOLS, np.eye(4), [c.Conv2d((1, 3, 3), (4, 1, 2), 1, 0, c.Xavier(), c.Sigmoid()), c.Dense(4, c.Xavier(), c.Softmax())], 1.0, 0.01),
        (SYMBOLS, np.eye(4), [c.Conv2d((1, 3, 3), (4, 1, 2), 1, 1, c.Xavier(), c.Sigmoid()), c.MaxPooling((4, 4, 4), 2, 2), c.Dense(4, c.Xavier(), c.Softmax())], 1.0, 0.01),
    ],
)
def test_small_models_learn(x, y, model, lr, bound):
    x, y = np.array(x, np.float32), np.array(y, np.float32)
    model = c.Sequential(model)
    net, p = network(model, x.shape[1]), initial_params(model, x.shape[1], 3)
    loss = training.cross_entropy if y.shape[1] > 1 else training.mse
    for _ in range(2000):
        value = training.run_epoch(net, p, x, y, loss, 4, lr, np.zeros(net.size, np.float32))
    assert value < bound
