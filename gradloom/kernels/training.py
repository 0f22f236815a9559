"""Losses, optimisers and the local training of one worker."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .. import config
from .layers import Network

#: Fixed value: the machine epsilon of 32-bit floats, the least probability that cross entropy divides by.
F32_EPS = np.float32(1.1920929e-07)
#: Fixed value: the smallest normal 64-bit float.
SMALLEST_NORMAL = 2.2250738585072014e-308


class EmptyEpoch(ValueError):
    """An epoch without a batch."""


def mse(p: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean over batch and outputs."""
    d = p - y
    return float(np.square(d, dtype=np.float64).sum() / d.size), (2 * d / d.size).astype(p.dtype)


def cross_entropy(p: np.ndarray, y: np.ndarray, reduction: str = "mean_elements") -> tuple[float, np.ndarray]:
    """``mean_elements`` divides by batch times classes, ``mean_rows`` by the batch."""
    n = p.size if reduction == "mean_elements" else len(p)
    q = np.maximum(p, F32_EPS)
    return float(-(y * np.log(q)).sum(dtype=np.float64) / n), (-(y / q) / n).astype(p.dtype)


def loss_of(kind: config.Variant):
    return mse if isinstance(kind, config.Mse) else cross_entropy


@dataclass
class Optimiser:
    """State of one optimiser over a parameter vector."""

    kind: config.Variant
    n: int
    t: int = 0
    state: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, params: np.ndarray, grad: np.ndarray) -> None:
        """Update ``params`` in place."""
        k = self.kind
        if isinstance(k, config.GradientDescent):
            params -= np.float32(k.lr) * grad
            return
        v = self.state.setdefault("v", np.zeros(self.n, np.float32))
        if isinstance(k, config.GradientDescentWithMomentum):
            v *= np.float32(k.mu)
            v += grad
            params -= np.float32(k.lr) * v
            return
        s = self.state.setdefault("s", np.zeros(self.n, np.float32))
        self.t += 1
        v *= np.float32(k.b1)
        v += np.float32(1 - k.b1) * grad
        s *= np.float32(k.b2)
        s += np.float32(1 - k.b2) * grad * grad
        step = np.float32(k.lr * np.sqrt(1 - k.b2**self.t) / (1 - k.b1**self.t))
        params -= step * v / (np.sqrt(s) + np.float32(k.eps))


def batches(n: int, size: int) -> Iterator[slice]:
    """Consecutive row ranges; the last may be short, none is empty."""
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def epoch_order(n: int, seed: int | None, worker: int, epoch: int) -> np.ndarray:
    """A permutation that follows from seed, worker and epoch alone."""
    if seed is None:
        return np.arange(n)
    return np.random.default_rng([seed, worker, epoch]).permutation(n)


def run_epoch(net: Network, params: np.ndarray, x: np.ndarray, y: np.ndarray, loss, batch_size: int, lr: float, residual: np.ndarray) -> float:
    """One pass of local gradient descent over the rows as they stand; adds every batch gradient to
    ``residual`` and returns the plain mean of the batch losses."""
    losses, grad = [], np.zeros(net.size, np.float32)
    for rows in batches(len(x), batch_size):
        value, delta = loss(net.forward(params, x[rows]), y[rows])
        grad[:] = 0
        net.backward(params, grad, delta)
        params -= np.float32(lr) * grad
        residual += grad
        losses.append(value)
    if not losses:
        raise EmptyEpoch("a worker has no rows")
    return float(np.mean(losses))


def local_training(net: Network, params: np.ndarray, x: np.ndarray, y: np.ndarray, loss, batch_size: int, lr: float, epochs: int, seed: int | None, worker: int, first_epoch: int) -> tuple[list[float], np.ndarray]:
    """What one worker does in a round: losses by epoch, and the sum of all batch gradients along its path."""
    own, residual, losses = params.astype(np.float32, copy=True), np.zeros(net.size, np.float32), []
    order = np.arange(len(x))
    for e in range(first_epoch, first_epoch + epochs):
        # Orders accumulate: each epoch shuffles the rows as the last one left them.
        order = order[epoch_order(len(x), seed, worker, e)]
        losses.append(run_epoch(net, own, x[order], y[order], loss, batch_size, lr, residual))
    return losses, residual
