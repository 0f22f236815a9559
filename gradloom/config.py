"""What a user writes: model, dataset and training configuration, and their JSON form.

Enum-like values follow one rule in JSON: a variant without fields is a bare
snake_case string, one with fields is an object with a single key.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that can't be run."""


def _finite(value: float, name: str) -> float:
    if not math.isfinite(value):
        raise ConfigError(f"{name} must be finite, got {value}")
    return float(value)


def unit_interval(value: float, name: str = "value") -> float:
    if not 0 <= _finite(value, name) <= 1:
        raise ConfigError(f"{name} must lie in [0, 1], got {value}")
    return float(value)


def positive(value: float, name: str = "value") -> float:
    if _finite(value, name) <= 0:
        raise ConfigError(f"{name} must be above 0, got {value}")
    return float(value)


def non_negative(value: float, name: str = "value") -> float:
    if _finite(value, name) < 0:
        raise ConfigError(f"{name} must not be negative, got {value}")
    return float(value)


def at_least_one(value: int, name: str) -> int:
    if int(value) != value or value < 1:
        raise ConfigError(f"{name} must be a whole number of 1 or more, got {value}")
    return int(value)


class Variant:
    """Base of the tagged values; ``key`` is the JSON tag."""

    @classmethod
    def key(cls) -> str:
        return getattr(cls, "KEY", None) or re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", cls.__name__).lower()

    def to_json(self) -> Any:
        own = {f.name: _plain(getattr(self, f.name)) for f in fields(self)}
        own = {k: v for k, v in own.items() if v is not None}
        return {self.key(): own} if own else self.key()


def _plain(value: Any) -> Any:
    if isinstance(value, Variant):
        return value.to_json()
    return [_plain(v) for v in value] if isinstance(value, tuple | list) else value


# Activations


@dataclass(frozen=True)
class Sigmoid(Variant):
    amp: float = 1.0


@dataclass(frozen=True)
class Tanh(Variant):
    amp: float = 1.0


@dataclass(frozen=True)
class ReLU(Variant):
    slope: float = 0.0
    KEY = "relu"

    def __post_init__(self) -> None:
        unit_interval(self.slope, "slope")


@dataclass(frozen=True)
class Softmax(Variant):
    pass


ACTIVATIONS = (Sigmoid, Tanh, ReLU, Softmax)

# Initialisers


@dataclass(frozen=True)
class Kaiming(Variant):
    pass


@dataclass(frozen=True)
class Xavier(Variant):
    pass


@dataclass(frozen=True)
class Lecun(Variant):
    pass


@dataclass(frozen=True)
class XavierUniform(Variant):
    pass


@dataclass(frozen=True)
class LecunUniform(Variant):
    pass


@dataclass(frozen=True)
class Const(Variant):
    value: float


@dataclass(frozen=True)
class Uniform(Variant):
    low: float
    high: float

    def __post_init__(self) -> None:
        if _finite(self.low, "low") >= _finite(self.high, "high"):
            raise ConfigError("low must be below high")


@dataclass(frozen=True)
class UniformInclusive(Variant):
    low: float
    high: float

    def __post_init__(self) -> None:
        if _finite(self.low, "low") > _finite(self.high, "high"):
            raise ConfigError("low must not be above high")


@dataclass(frozen=True)
class Normal(Variant):
    mean: float
    std_dev: float

    def __post_init__(self) -> None:
        _finite(self.mean, "mean")
        non_negative(self.std_dev, "std_dev")


@dataclass(frozen=True)
class InlineParams(Variant):
    """Explicit parameters, such as those handed over when the strategy switches."""

    values: tuple[float, ...]


INITIALISERS = (Kaiming, Xavier, Lecun, XavierUniform, LecunUniform, Const, Uniform, UniformInclusive, Normal, InlineParams)

# Layers


@dataclass(frozen=True)
class Dense(Variant):
    output_size: int
    init: Variant = field(default_factory=Kaiming)
    act_fn: Variant | None = None

    def __post_init__(self) -> None:
        at_least_one(self.output_size, "output_size")


@dataclass(frozen=True)
class Conv2d(Variant):
    input_dim: tuple[int, int, int]
    kernel_dim: tuple[int, int, int]
    stride: int = 1
    padding: int = 0
    init: Variant = field(default_factory=Kaiming)
    act_fn: Variant | None = None
    KEY = "conv"

    def __post_init__(self) -> None:
        for v in (*self.input_dim, *self.kernel_dim, self.stride):
            at_least_one(v, "a dimension")
        non_negative(self.padding, "padding")

    @property
    def output_dim(self) -> tuple[int, int, int]:
        _, h, w = self.input_dim
        f, _, k = self.kernel_dim
        return f, (h + 2 * self.padding - k) // self.stride + 1, (w + 2 * self.padding - k) // self.stride + 1


@dataclass(frozen=True)
class MaxPooling(Variant):
    input_dim: tuple[int, int, int]
    filter_size: int
    stride: int
    padding: int = 0
    act_fn: Variant | None = None

    def __post_init__(self) -> None:
        for v in (*self.input_dim, self.filter_size, self.stride):
            at_least_one(v, "a dimension")
        non_negative(self.padding, "padding")

    @property
    def output_dim(self) -> tuple[int, int, int]:
        c, h, w = self.input_dim
        return c, (h + 2 * self.padding - self.filter_size) // self.stride + 1, (w + 2 * self.padding - self.filter_size) // self.stride + 1


@dataclass(frozen=True)
class Sequential:
    layers: tuple[Variant, ...]

    def __init__(self, layers: Any):
        object.__setattr__(self, "layers", tuple(layers))

    def to_json(self) -> dict:
        return {"layers": _plain(self.layers)}


# Datasets


@dataclass(frozen=True)
class InlineDataset:
    samples: tuple[float, ...]
    labels: tuple[float, ...]
    x_size: int
    y_size: int


@dataclass(frozen=True)
class LocalDataset:
    samples_path: str
    labels_path: str
    x_size: int
    y_size: int


@dataclass(frozen=True)
class DataFrameDataset:
    """Rows of a DataFrame: ``features`` is an array column, ``label`` an array or, with ``classes``, a class number."""

    df: Any
    features: str = "x"
    label: str = "y"
    row_id: str = "row_id"
    x_size: int = 0
    y_size: int = 0
    classes: int | None = None


# Optimisers


@dataclass(frozen=True)
class GradientDescent(Variant):
    lr: float

    def __post_init__(self) -> None:
        positive(self.lr, "lr")


@dataclass(frozen=True)
class GradientDescentWithMomentum(Variant):
    lr: float
    mu: float

    def __post_init__(self) -> None:
        positive(self.lr, "lr")
        unit_interval(self.mu, "mu")


@dataclass(frozen=True)
class Adam(Variant):
    lr: float
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8

    def __post_init__(self) -> None:
        positive(self.lr, "lr")
        unit_interval(self.b1, "b1")
        unit_interval(self.b2, "b2")
        positive(self.eps, "eps")


# Losses, serialisers, synchronisers, stores


@dataclass(frozen=True)
class Mse(Variant):
    pass


@dataclass(frozen=True)
class CrossEntropy(Variant):
    pass


@dataclass(frozen=True)
class BaseSerializer(Variant):
    KEY = "base"


@dataclass(frozen=True)
class SparseSerializer(Variant):
    """Sends about the share ``r`` of the entries, those of largest size (a keep ratio)."""

    r: float
    KEY = "sparse_capable"

    def __post_init__(self) -> None:
        unit_interval(self.r, "r")

    @property
    def keep_ratio(self) -> float:
        return self.r


@dataclass(frozen=True)
class BarrierSync(Variant):
    KEY = "barrier"


@dataclass(frozen=True)
class NonBlockingSync(Variant):
    KEY = "non_blocking"


@dataclass(frozen=True)
class BlockingStore(Variant):
    KEY = "blocking"


@dataclass(frozen=True)
class WildStore(Variant):
    KEY = "wild"


# Algorithms


@dataclass(frozen=True)
class AllReduce(Variant):
    pass


@dataclass(frozen=True)
class ParameterServer(Variant):
    nservers: int
    synchronizer: Variant = field(default_factory=BarrierSync)
    store: Variant = field(default_factory=BlockingStore)

    def __post_init__(self) -> None:
        at_least_one(self.nservers, "nservers")


@dataclass(frozen=True)
class StrategySwitch(ParameterServer):
    pass


@dataclass(frozen=True)
class EarlyStopping:
    tolerance: float

    def __post_init__(self) -> None:
        non_negative(self.tolerance, "tolerance")


@dataclass(frozen=True)
class TrainingConfig:
    n_nodes: int
    algorithm: Variant
    dataset: InlineDataset | LocalDataset | DataFrameDataset
    optimizer: Variant
    loss_fn: Variant
    batch_size: int
    max_epochs: int
    offline_epochs: int = 0
    serializer: Variant = field(default_factory=BaseSerializer)
    seed: int | None = None
    early_stopping: EarlyStopping | None = None
    #: Round-trip times between nodes: (from, to, seconds), for role and ring planning.
    latencies: tuple[tuple[int, int, float], ...] = ()
    #: Shuffle the rows of each worker before every local epoch.
    shuffle: bool = True

    def __post_init__(self) -> None:
        at_least_one(self.batch_size, "batch_size")
        at_least_one(self.max_epochs, "max_epochs")
        non_negative(self.offline_epochs, "offline_epochs")

    @property
    def n_servers(self) -> int:
        return self.algorithm.nservers if isinstance(self.algorithm, ParameterServer) else 0

    @property
    def n_workers(self) -> int:
        """Workers at the start; a run that switches starts with every node a worker."""
        return self.n_nodes - (self.n_servers if type(self.algorithm) is ParameterServer else 0)


def _nodes(n: Any) -> int:
    """Nodes may be given as a count or, as in the JSON form, as a list of addresses."""
    return n if isinstance(n, int) else len(n)


def _early(tolerance: float | None) -> EarlyStopping | None:
    return None if tolerance is None else EarlyStopping(positive(tolerance, "early_stopping_tolerance"))


def all_reduce(addrs, dataset, optimizer, loss_fn, max_epochs, batch_size, serializer=None, offline_epochs=0, seed=None, early_stopping_tolerance=None, **more) -> TrainingConfig:
    """A run in which all nodes are workers and every round averages their gradients."""
    return TrainingConfig(_nodes(addrs), AllReduce(), dataset, optimizer, loss_fn, batch_size, max_epochs, offline_epochs, serializer or BaseSerializer(), seed, _early(early_stopping_tolerance), **more)


def parameter_server(addrs, nservers, dataset, optimizer, loss_fn, sync, store, max_epochs, batch_size, serializer=None, offline_epochs=0, seed=None, early_stopping_tolerance=None, **more) -> TrainingConfig:
    """A run in which ``nservers`` of the nodes keep the parameters."""
    return TrainingConfig(_nodes(addrs), ParameterServer(nservers, sync, store), dataset, optimizer, loss_fn, batch_size, max_epochs, offline_epochs, serializer or BaseSerializer(), seed, _early(early_stopping_tolerance), **more)


def strategy_switch(addrs, nservers, dataset, optimizer, loss_fn, sync, store, max_epochs, batch_size, serializer=None, offline_epochs=0, seed=None, early_stopping_tolerance=None, **more) -> TrainingConfig:
    """A run that starts as all-reduce and turns to parameter servers when the loss flattens."""
    return TrainingConfig(_nodes(addrs), StrategySwitch(nservers, sync, store), dataset, optimizer, loss_fn, batch_size, max_epochs, offline_epochs, serializer or BaseSerializer(), seed, _early(early_stopping_tolerance), **more)


# JSON


def variant(value: Any, kinds: tuple[type, ...], what: str) -> Any:
    """The dataclass for a JSON value: a bare tag, or one tag with its fields."""
    tag, own = (value, {}) if isinstance(value, str) else next(iter(value.items())) if isinstance(value, dict) and len(value) == 1 else (None, {})
    for kind in kinds:
        if kind.key() == tag:
            known = {f.name for f in fields(kind)}
            if extra := set(own) - known:
                raise ConfigError(f"{what} {tag} has no field {sorted(extra)[0]}")
            try:
                return kind(**{k: _nested(k, v) for k, v in own.items()})
            except TypeError as e:
                raise ConfigError(f"{what} {tag}: {e}") from e
    raise ConfigError(f"unknown {what}: {value!r}")


def _nested(name: str, value: Any) -> Any:
    kinds = {"init": INITIALISERS, "act_fn": ACTIVATIONS, "synchronizer": (BarrierSync, NonBlockingSync), "store": (BlockingStore, WildStore)}
    if name in kinds:
        return None if value is None else variant(value, kinds[name], name)
    return tuple(value) if isinstance(value, list) else value


def model_from_json(text: str) -> Sequential:
    return Sequential([variant(x, (Dense, Conv2d, MaxPooling), "layer") for x in json.loads(text)["layers"]])


def training_from_json(text: str) -> TrainingConfig:
    raw = json.loads(text)
    data = raw["dataset"]
    kind, own = next(iter(data["src"].items()))
    if kind not in ("inline", "local"):
        raise ConfigError(f"unknown dataset source: {kind}")
    sizes = data["x_size"], data["y_size"]
    dataset = InlineDataset(tuple(own["samples"]), tuple(own["labels"]), *sizes) if kind == "inline" else LocalDataset(own["samples_path"], own["labels_path"], *sizes)
    stop = raw.get("early_stopping")
    return TrainingConfig(
        n_nodes=len(raw["addrs"]),
        algorithm=variant(raw["algorithm"], (AllReduce, ParameterServer, StrategySwitch), "algorithm"),
        dataset=dataset,
        optimizer=variant(raw["optimizer"], (GradientDescent, GradientDescentWithMomentum, Adam), "optimizer"),
        loss_fn=variant(raw["loss_fn"], (Mse, CrossEntropy), "loss_fn"),
        batch_size=raw["batch_size"],
        max_epochs=raw["max_epochs"],
        offline_epochs=raw.get("offline_epochs", 0),
        serializer=variant(raw.get("serializer") or "base", (BaseSerializer, SparseSerializer), "serializer"),
        seed=raw.get("seed"),
        early_stopping=EarlyStopping(stop["tolerance"]) if stop else None,
    )


def load_model(path: str) -> Sequential:
    return model_from_json(Path(path).read_text())


def load_training(path: str) -> TrainingConfig:
    return training_from_json(Path(path).read_text())


def loss_from_wire(value: float | None) -> float:
    """A loss that isn't a number travels as null."""
    return math.nan if value is None else float(value)


def loss_to_wire(value: float) -> float | None:
    return float(value) if math.isfinite(value) else None
