"""Checks before any job runs."""

from __future__ import annotations

from math import prod

from .. import config as c


def layer_sizes(model: c.Sequential, x_size: int) -> list[tuple[int, int]]:
    """(input size, output size) of each layer; raises where they don't fit together."""
    out, size = [], x_size
    for k, layer in enumerate(model.layers):
        if isinstance(layer, c.Dense):
            own = size, layer.output_size
        else:
            if prod(layer.input_dim) != size:
                raise c.ConfigError(f"layer {k} takes {prod(layer.input_dim)} values, but gets {size}")
            own = size, prod(layer.output_dim)
        out.append(own)
        size = own[1]
    return out


def validate_model(model: c.Sequential) -> None:
    if not model.layers:
        raise c.ConfigError("a model needs at least one layer")
    for k, layer in enumerate(model.layers):
        if isinstance(layer, c.Dense):
            continue
        window = layer.kernel_dim[2] if isinstance(layer, c.Conv2d) else layer.filter_size
        if isinstance(layer, c.Conv2d) and layer.kernel_dim[1] != layer.input_dim[0]:
            raise c.ConfigError(f"layer {k}: the kernel has {layer.kernel_dim[1]} channels, the input {layer.input_dim[0]}")
        for d in layer.input_dim[1:]:
            # Strict, as users of the JSON form know it: a window as large as the padded input is refused.
            if d + 2 * layer.padding - window <= 0:
                raise c.ConfigError(f"layer {k}: a window of {window} doesn't fit {d} with padding {layer.padding}")


def validate_training(t: c.TrainingConfig) -> None:
    if t.n_nodes < 1:
        raise c.ConfigError("at least one node is needed")
    if t.n_servers >= t.n_nodes:
        raise c.ConfigError(f"{t.n_servers} servers leave no worker among {t.n_nodes} nodes")
    d = t.dataset
    if isinstance(d, c.InlineDataset):
        for values, width, what in ((d.samples, d.x_size, "samples"), (d.labels, d.y_size, "labels")):
            if len(values) % width:
                raise c.ConfigError(f"{len(values)} {what} can't be cut into rows of {width}")
        if len(d.samples) // d.x_size != len(d.labels) // d.y_size:
            raise c.ConfigError("samples and labels have different row counts")
        validate_rows(t, len(d.samples) // d.x_size)


def validate_rows(t: c.TrainingConfig, rows: int) -> None:
    if rows < 1:
        raise c.ConfigError("the dataset has no rows")
    if t.batch_size > rows:
        raise c.ConfigError(f"a batch of {t.batch_size} is larger than the dataset of {rows} rows")


def validate_dimensions(model: c.Sequential, x_size: int, y_size: int) -> None:
    if (out := layer_sizes(model, x_size)[-1][1]) != y_size:
        raise c.ConfigError(f"the model gives {out} values a row, the labels have {y_size}")


def validate(model: c.Sequential, t: c.TrainingConfig) -> None:
    validate_model(model)
    validate_training(t)
    validate_dimensions(model, t.dataset.x_size, t.dataset.y_size)
