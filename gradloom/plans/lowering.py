"""From a model's configuration to kernels, with the reshapes that layers need between them."""

from __future__ import annotations

from .. import config as c
from ..kernels import layers as k
from .validate import layer_sizes


def activation(act: c.Variant) -> k.Kernel:
    return {c.Sigmoid: lambda: k.SigmoidKernel(act.amp), c.Tanh: lambda: k.TanhKernel(act.amp), c.ReLU: lambda: k.ReLUKernel(act.slope), c.Softmax: k.SoftmaxKernel}[type(act)]()


def kernels(model: c.Sequential, x_size: int) -> list[tuple[int, k.Kernel]]:
    """(layer of the model, kernel). Images are flattened before dense layers and before softmax, which
    works on whole rows; they are formed again where a convolution or pooling follows."""
    out: list[tuple[int, k.Kernel]] = []
    image: tuple[int, int, int] | None = None
    for i, (layer, (inputs, _)) in enumerate(zip(model.layers, layer_sizes(model, x_size), strict=True)):
        add = lambda kernel, i=i: out.append((i, kernel))
        if isinstance(layer, c.Dense):
            if image:
                add(k.ToFlat(*image))
                image = None
            add(k.DenseKernel(inputs, layer.output_size))
        else:
            if image != tuple(layer.input_dim):
                if image:
                    add(k.ToFlat(*image))
                add(k.ToImage(*layer.input_dim))
            if isinstance(layer, c.Conv2d):
                add(k.ConvKernel(layer.kernel_dim[0], layer.kernel_dim[1], layer.kernel_dim[2], layer.stride, layer.padding))
            else:
                add(k.PoolKernel(layer.filter_size, layer.stride, layer.padding))
            image = layer.output_dim
        if layer.act_fn is not None:
            if image and isinstance(layer.act_fn, c.Softmax):
                add(k.ToFlat(*image))
                image = None
            add(activation(layer.act_fn))
    if image:
        out.append((len(model.layers) - 1, k.ToFlat(*image)))
    return out


def network(model: c.Sequential, x_size: int) -> k.Network:
    return k.Network([kernel for _, kernel in kernels(model, x_size)])


def layer_params(model: c.Sequential, x_size: int) -> list[int]:
    """Parameters of each layer of the model."""
    out = [0] * len(model.layers)
    for i, kernel in kernels(model, x_size):
        out[i] += kernel.size
    return out
