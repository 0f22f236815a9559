"""Which server keeps which layer, and how a vector is cut into contiguous parts."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from .. import config as c


@dataclass(frozen=True)
class Slot:
    layer: int
    server: int
    #: Range within the server's parameters.
    start: int
    end: int


def balanced(sizes: list[int], bins: int) -> list[int]:
    """Bin of each item: largest items first (ties: first item), each into the lightest bin (ties: lowest bin)."""
    heap = [(0, b) for b in range(bins)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, b = heapq.heappop(heap)
        out[i] = b
        heapq.heappush(heap, (load + sizes[i], b))
    return out


def placement(sizes: list[int], servers: int) -> list[Slot]:
    """A slot for each layer, in model order."""
    used, out = [0] * servers, []
    for layer, server in enumerate(balanced(sizes, servers)):
        out.append(Slot(layer, server, used[server], used[server] + sizes[layer]))
        used[server] += sizes[layer]
    return out


def scatter(params: np.ndarray, sizes: list[int], slots: list[Slot]) -> list[np.ndarray]:
    """The vector of each server from the model's."""
    ends = np.cumsum(sizes)
    by: dict[int, list[np.ndarray]] = {}
    for s in slots:
        by.setdefault(s.server, []).append(params[ends[s.layer] - sizes[s.layer] : ends[s.layer]])
    return [np.concatenate(by.get(k, [np.zeros(0, np.float32)])) for k in range(max(by, default=0) + 1)]


def gather(parts: list[np.ndarray], slots: list[Slot]) -> np.ndarray:
    """The model's vector from the servers'."""
    return np.concatenate([parts[s.server][s.start : s.end] for s in sorted(slots, key=lambda s: s.layer)])


def contiguous(n: int, parts: int) -> list[tuple[int, int]]:
    """Ranges of n items; the first n % parts have one more."""
    base, extra = divmod(n, parts)
    ends = [(k + 1) * base + min(k + 1, extra) for k in range(parts)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def shards(n_params: int, cores: int) -> tuple[int, int]:
    """(number of shards, size of each) that a server's store is cut into."""
    count = max(1, min(n_params, 2 * cores))
    return count, -(-n_params // count)


def worker_optimiser(t: c.TrainingConfig) -> c.Variant:
    """Workers of a parameter-server run step with plain gradient descent; servers hold the real optimiser."""
    return c.GradientDescent(t.optimizer.lr) if type(t.algorithm) is c.ParameterServer else t.optimizer
