"""Forward and backward passes. A layer reads its parameters from a slice of one flat vector."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class ShapeError(ValueError):
    """Input of the wrong rank or size for a layer."""


def ranked(x: np.ndarray, rank: int) -> np.ndarray:
    if x.ndim != rank:
        raise ShapeError(f"a rank of {rank} is needed, got {x.ndim}")
    return x


class Kernel:
    """Layers without parameters keep size 0."""

    size = 0

    def forward(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def backward(self, params: np.ndarray, grad: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """The delta of the input; writes this layer's gradient into ``grad``."""
        raise NotImplementedError

    def gradients(self, params: np.ndarray, grad: np.ndarray, delta: np.ndarray) -> None:
        """Like ``backward``, where the delta of the input isn't wanted."""
        self.backward(params, grad, delta)


@dataclass
class DenseKernel(Kernel):
    inputs: int
    outputs: int

    @property
    def size(self) -> int:
        return (self.inputs + 1) * self.outputs

    def _split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.inputs * self.outputs
        return flat[:n].reshape(self.inputs, self.outputs), flat[n:]

    def forward(self, params, x):
        weights, bias = self._split(params)
        self.x = ranked(x, 2)
        return x @ weights + bias

    def gradients(self, params, grad, delta):
        to_weights, to_bias = self._split(grad)
        to_weights[...] = self.x.T @ delta
        to_bias[...] = delta.sum(axis=0)

    def backward(self, params, grad, delta):
        self.gradients(params, grad, delta)
        weights, _ = self._split(params)
        return delta @ weights.T


def _inside_out(x: np.ndarray, p: int = 0) -> np.ndarray:
    """(channels, height, width, batch) of (batch, channels, height, width), with ``p`` zeros around each image.

    Layers keep images in memory with the batch innermost, so that all steps run over stretches of it; what they
    hand on is a view of that in the outer order.
    """
    x = x.transpose(1, 2, 3, 0)
    if not p:
        return np.ascontiguousarray(x)
    c, h, w, b = x.shape
    out = np.zeros((c, h + 2 * p, w + 2 * p, b), x.dtype)
    out[:, p : p + h, p : p + w] = x
    return out


def _places(k: int, stride: int, out: tuple[int, int]) -> list[tuple[slice, slice]]:
    """For each cell of a k x k window, where it lies in the padded image for all window positions at once."""
    return [(slice(i, i + stride * out[0], stride), slice(j, j + stride * out[1], stride)) for i in range(k) for j in range(k)]


def _outputs(shape: tuple[int, ...], k: int, stride: int, padding: int) -> tuple[int, int]:
    """Window positions; rows and columns that don't fill a window are left out."""
    return (shape[2] + 2 * padding - k) // stride + 1, (shape[3] + 2 * padding - k) // stride + 1


@dataclass
class ConvKernel(Kernel):
    filters: int
    channels: int
    k: int
    stride: int = 1
    padding: int = 0

    @property
    def size(self) -> int:
        return self.filters * (self.channels * self.k * self.k + 1)

    def _split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size - self.filters
        return flat[:n].reshape(self.filters, -1), flat[n:]

    def forward(self, params, x):
        kernels, bias = self._split(params)
        if ranked(x, 4).shape[1] != self.channels:
            raise ShapeError(f"{self.channels} channels are needed, got {x.shape[1]}")
        self.shape, self.out = x.shape, _outputs(x.shape, self.k, self.stride, self.padding)
        image = _inside_out(x, self.padding)
        cells = np.empty((self.channels, self.k * self.k, *self.out, len(x)), x.dtype)
        for n, (rows, cols) in enumerate(_places(self.k, self.stride, self.out)):
            cells[:, n] = image[:, rows, cols]
        self.cells = cells.reshape(kernels.shape[1], -1)
        out = kernels @ self.cells
        out += bias[:, None]
        return out.reshape(self.filters, *self.out, len(x)).transpose(3, 0, 1, 2)

    def _flat(self, delta: np.ndarray) -> np.ndarray:
        return _inside_out(delta).reshape(self.filters, -1)

    def gradients(self, params, grad, delta):
        self._gradients(grad, self._flat(delta))

    def _gradients(self, grad: np.ndarray, flat: np.ndarray) -> None:
        to_kernels, to_bias = self._split(grad)
        to_kernels[...] = flat @ self.cells.T
        to_bias[...] = flat.sum(axis=1)

    def backward(self, params, grad, delta):
        flat = self._flat(delta)
        self._gradients(grad, flat)
        kernels, _ = self._split(params)
        b, c, h, w = self.shape
        p = self.padding
        # Scatter over the padded image, then crop: right for any padding.
        out = np.zeros((c, h + 2 * p, w + 2 * p, b), delta.dtype)
        spread = (kernels.T @ flat).reshape(c, self.k * self.k, *self.out, b)
        for n, (rows, cols) in enumerate(_places(self.k, self.stride, self.out)):
            out[:, rows, cols] += spread[:, n]
        return out[:, p : p + h, p : p + w].transpose(3, 0, 1, 2)


@dataclass
class PoolKernel(Kernel):
    k: int
    stride: int
    padding: int = 0

    def forward(self, params, x):
        self.shape, self.out = ranked(x, 4).shape, _outputs(x.shape, self.k, self.stride, self.padding)
        self.image, self.best = _inside_out(x, self.padding), None
        for rows, cols in _places(self.k, self.stride, self.out):
            cell = self.image[:, rows, cols]
            self.best = cell.copy() if self.best is None else np.maximum(self.best, cell, out=self.best)
        return self.best.transpose(3, 0, 1, 2)

    def backward(self, params, grad, delta):
        b, c, h, w = self.shape
        p = self.padding
        out = np.zeros((c, h + 2 * p, w + 2 * p, b), delta.dtype)
        # The last of equal maxima wins: from the back, each window's delta goes to the first that has it.
        left = _inside_out(delta).copy()
        for rows, cols in reversed(_places(self.k, self.stride, self.out)):
            own = left * (self.image[:, rows, cols] == self.best)
            out[:, rows, cols] += own
            left -= own
        return out[:, p : p + h, p : p + w].transpose(3, 0, 1, 2)


@dataclass
class SigmoidKernel(Kernel):
    amp: float = 1.0

    def forward(self, params, x):
        with np.errstate(over="ignore"):
            self.a = (self.amp / (1 + np.exp(-x))).astype(x.dtype)
        return self.a

    def backward(self, params, grad, delta):
        return delta * self.a * (1 - self.a / self.amp)


@dataclass
class TanhKernel(Kernel):
    amp: float = 1.0

    def forward(self, params, x):
        self.a = (self.amp * np.tanh(x)).astype(x.dtype)
        return self.a

    def backward(self, params, grad, delta):
        return delta * (self.amp - self.a * self.a / self.amp)


@dataclass
class ReLUKernel(Kernel):
    slope: float = 0.0

    def forward(self, params, x):
        self.positive = x > 0
        return np.where(self.positive, x, self.slope * x).astype(x.dtype, copy=False)

    def backward(self, params, grad, delta):
        return np.where(self.positive, delta, self.slope * delta).astype(delta.dtype, copy=False) if self.slope else delta * self.positive


@dataclass
class SoftmaxKernel(Kernel):
    def forward(self, params, x):
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        self.a = e / e.sum(axis=-1, keepdims=True)
        return self.a

    def backward(self, params, grad, delta):
        return self.a * (delta - (self.a * delta).sum(axis=-1, keepdims=True))


@dataclass
class ToImage(Kernel):
    """(batch, c*h*w) to (batch, c, h, w)."""

    channels: int
    height: int
    width: int

    def forward(self, params, x):
        n = self.channels * self.height * self.width
        if ranked(x, 2).shape[1] != n:
            raise ShapeError(f"{n} values a row are needed, got {x.shape[1]}")
        return x.reshape(-1, self.channels, self.height, self.width)

    def backward(self, params, grad, delta):
        return delta.reshape(len(delta), -1)


@dataclass
class ToFlat(Kernel):
    """(batch, c, h, w) to (batch, c*h*w)."""

    channels: int
    height: int
    width: int

    def forward(self, params, x):
        if ranked(x, 4).shape[1:] != (self.channels, self.height, self.width):
            raise ShapeError(f"{(self.channels, self.height, self.width)} is needed, got {x.shape[1:]}")
        return x.reshape(len(x), -1)

    def backward(self, params, grad, delta):
        return delta.reshape(-1, self.channels, self.height, self.width)


@dataclass
class Network:
    """Layers in order over one flat parameter vector."""

    layers: list[Kernel]
    ranges: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        at = 0
        self.ranges = []
        for layer in self.layers:
            self.ranges.append((at, at + layer.size))
            at += layer.size
        self.size = at

    def forward(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        for layer, (a, b) in zip(self.layers, self.ranges, strict=True):
            x = layer.forward(params[a:b], x)
        return x

    def backward(self, params: np.ndarray, grad: np.ndarray, delta: np.ndarray) -> None:
        """All gradients, from the delta of the output. Nothing before the first layer with parameters is needed."""
        first = next((k for k, layer in enumerate(self.layers) if layer.size), len(self.layers))
        for k in range(len(self.layers) - 1, first - 1, -1):
            a, b = self.ranges[k]
            if k == first:
                self.layers[k].gradients(params[a:b], grad[a:b], delta)
            else:
                delta = self.layers[k].backward(params[a:b], grad[a:b], delta)
