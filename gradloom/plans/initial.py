"""Initial parameters: one draw on the driver, so that all workers start alike."""

from __future__ import annotations

import secrets

import numpy as np

from .. import config as c
from .lowering import layer_params
from .validate import layer_sizes


def draw(init: c.Variant, n: int, fan_in: int, fan_out: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` parameters, biases among them. Fans are the flat input and output sizes of the layer."""
    if isinstance(init, c.Const):
        return np.full(n, init.value, np.float32)
    if isinstance(init, c.InlineParams):
        if len(init.values) != n:
            raise c.ConfigError(f"{len(init.values)} parameters given, {n} needed")
        return np.array(init.values, np.float32)
    if isinstance(init, c.Uniform):
        return rng.uniform(init.low, init.high, n).astype(np.float32)
    if isinstance(init, c.UniformInclusive):
        # The upper end itself can be drawn.
        return (init.low + (init.high - init.low) * rng.integers(0, 2**32, n, endpoint=True) / 2.0**32).astype(np.float32)
    if isinstance(init, c.Normal):
        return rng.normal(init.mean, init.std_dev, n).astype(np.float32)
    limits = {c.XavierUniform: 6 / (fan_in + fan_out), c.LecunUniform: 3 / fan_in}
    if type(init) in limits:
        limit = np.sqrt(limits[type(init)])
        return rng.uniform(-limit, limit, n).astype(np.float32)
    deviations = {c.Kaiming: 2 / fan_in, c.Xavier: 2 / (fan_in + fan_out), c.Lecun: 1 / fan_in}
    return rng.normal(0, np.sqrt(deviations[type(init)]), n).astype(np.float32)


def initial_params(model: c.Sequential, x_size: int, seed: int) -> np.ndarray:
    """The flat vector of all layers, drawn in model order from one stream."""
    rng = np.random.default_rng(seed)
    parts = []
    for layer, n, (fan_in, fan_out) in zip(model.layers, layer_params(model, x_size), layer_sizes(model, x_size), strict=True):
        parts.append(draw(layer.init, n, fan_in, fan_out, rng) if n else np.zeros(0, np.float32))
    return np.concatenate(parts)


def resolve_seed(seed: int | None) -> int:
    """A run without a seed draws one, so that it can be recorded."""
    return secrets.randbits(32) if seed is None else seed
