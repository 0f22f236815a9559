"""Training strategies: what happens between the workers' local training and the next parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import config as c
from .kernels import codec
from .kernels.training import Optimiser
from .plans.placement import Slot, gather, placement, scatter

#: What a round gets from the workers: worker -> (losses, sum of batch gradients).
Results = dict[int, tuple[list[float], np.ndarray]]


@dataclass
class Strategy:
    """Shared state: the parameters, and what each worker's compression has left for later rounds.

    Vectors live on the driver: one of the model's size, and for sparse pushes one a worker. Gradients are summed in
    worker order in double precision, so that results don't depend on the order in which tasks end.
    """

    params: np.ndarray
    workers: int
    keep_ratio: float | None
    left: dict[int, np.ndarray] = field(default_factory=dict)

    def start_params(self) -> np.ndarray:
        """What the workers of the next round start from: one vector, or one row a worker."""
        return self.params

    def arrived(self, worker: int, grad: np.ndarray) -> np.ndarray:
        """The gradient as it comes over the wire, with error feedback."""
        residual = grad + self.left[worker] if worker in self.left else grad
        out, self.left[worker] = codec.send(residual, self.keep_ratio)
        return out

    def mean(self, results: Results) -> np.ndarray:
        total = np.zeros(len(self.params), np.float64)
        for worker in sorted(results):
            total += self.arrived(worker, results[worker][1])
        return (total / len(results)).astype(np.float32)

    @property
    def needs_mean_alone(self) -> bool:
        """Whether a round needs no more of the gradients than their mean, each rounded to half precision: nothing is left
        for later rounds then, and the mean may be taken where the gradients lie."""
        return False

    def apply_mean(self, grad: np.ndarray) -> None:
        """Step with a round's mean gradient."""
        raise NotImplementedError

    def finish_round(self, results: Results, round_no: int) -> list[dict]:
        """Update the parameters; returns events beside the losses."""
        raise NotImplementedError


@dataclass
class AllReduceRun(Strategy):
    """Every worker holds the same vector; one optimiser steps with the mean gradient."""

    optimiser: Optimiser | None = None

    @property
    def needs_mean_alone(self):
        return self.keep_ratio is None

    def apply_mean(self, grad):
        self.optimiser.step(self.params, grad)

    def finish_round(self, results, round_no):
        self.apply_mean(self.mean(results))
        return []


@dataclass
class ParameterServerRun(Strategy):
    """Layers are spread over servers, each with its own optimiser state.

    With a barrier, a blocking store averages all gradients of a round and a wild one applies each as it
    comes. Without a barrier gradients are applied one by one in a recorded order, each computed at the
    parameters that its worker pulled after its own last push; a blocking store still divides each by the
    number of workers.
    """

    kind: c.ParameterServer | None = None
    sizes: list[int] = field(default_factory=list)
    optimizer: c.Variant | None = None
    order: Callable[[int, list[int]], list[int]] = lambda round_no, workers: workers
    slots: list[Slot] = field(default_factory=list)
    optimisers: list[Optimiser] = field(default_factory=list)
    pulled: dict[int, np.ndarray] = field(default_factory=dict)
    versions: dict[int, int] = field(default_factory=dict)
    version: int = 0

    def __post_init__(self) -> None:
        self.slots = placement(self.sizes, self.kind.nservers)
        self.optimisers = [Optimiser(self.optimizer, len(p)) for p in scatter(self.params, self.sizes, self.slots)]

    @property
    def waits(self) -> bool:
        return isinstance(self.kind.synchronizer, c.BarrierSync)

    @property
    def averages(self) -> bool:
        return isinstance(self.kind.store, c.BlockingStore)

    def start_params(self):
        if self.waits:
            return self.params
        return np.stack([self.pulled.get(w, self.params) for w in range(self.workers)])

    def update(self, grad: np.ndarray) -> None:
        parts = scatter(self.params, self.sizes, self.slots)
        for optimiser, part, g in zip(self.optimisers, parts, scatter(grad, self.sizes, self.slots), strict=True):
            optimiser.step(part, g)
        self.params = gather(parts, self.slots)
        self.version += 1

    @property
    def needs_mean_alone(self):
        return self.keep_ratio is None and self.waits and self.averages

    def apply_mean(self, grad):
        self.update(grad)

    def finish_round(self, results, round_no):
        if self.waits and self.averages:
            self.apply_mean(self.mean(results))
            return []
        events = []
        for worker in self.order(round_no, sorted(results)):
            grad = self.arrived(worker, results[worker][1])
            self.update(grad / np.float32(self.workers) if self.averages else grad)
            if not self.waits:
                events.append({"kind": "push", "worker": worker, "detail": f"staleness={self.version - 1 - self.versions.get(worker, 0)}"})
                self.pulled[worker], self.versions[worker] = self.params.copy(), self.version
        return events
