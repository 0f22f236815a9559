"""Model files: safetensors on the driver, Parquet through Spark."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import config as c
from ..plans.lowering import layer_params
from ..plans.validate import layer_sizes


def tensors(model: c.Sequential, x_size: int, params: np.ndarray) -> list[tuple[str, list[int], np.ndarray]]:
    """(name, shape, values): weight and bias of each layer in order; both empty for pooling."""
    out, at = [], 0
    for i, (layer, n, (inputs, _)) in enumerate(zip(model.layers, layer_params(model, x_size), layer_sizes(model, x_size), strict=True)):
        own = params[at : at + n]
        at += n
        if isinstance(layer, c.Dense):
            shape, bias = [inputs, layer.output_size], layer.output_size
        elif isinstance(layer, c.Conv2d):
            f, ch, k = layer.kernel_dim
            shape, bias = [f, ch, k, k], f
        else:
            shape, bias = [0], 0
        cut = len(own) - bias
        out += [(f"layer_{i}.weight", shape, own[:cut]), (f"layer_{i}.bias", [bias], own[cut:])]
    return out


def safetensors(named: list[tuple[str, list[int], np.ndarray]]) -> bytes:
    """Header length (64-bit little-endian), JSON header, raw little-endian values."""
    header, body = {}, b""
    for name, shape, values in named:
        raw = values.astype("<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": shape, "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + body


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    raw = Path(path).read_bytes()
    (n,) = struct.unpack_from("<Q", raw)
    header = json.loads(raw[8 : 8 + n])
    body = raw[8 + n :]
    return {k: np.frombuffer(body[slice(*v["data_offsets"])], "<f4").reshape(v["shape"]) for k, v in header.items() if k != "__metadata__"}


def save_safetensors(path: str, model: c.Sequential, x_size: int, params: np.ndarray) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(safetensors(tensors(model, x_size, params)))


def params_table(spark: SparkSession, model: c.Sequential, x_size: int, params: np.ndarray) -> DataFrame:
    """(layer, name, shape, values) of a model."""
    rows = [(int(n.split(".")[0].split("_")[1]), n.split(".")[1], shape, v.astype(float).tolist()) for n, shape, v in tensors(model, x_size, params)]
    return spark.createDataFrame(rows, "layer int, name string, shape array<int>, values array<float>")
