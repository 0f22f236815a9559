"""Layers over tensors in long form.

A row vector is (row, i, value); an image is (row, i, value) with i = (channel * height + r) * width + c.
Weights are small tables; a join against them is a broadcast below the session's threshold and a
shuffle above it, which the optimiser decides by their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.layers import ConvKernel


def long_form(df: DataFrame, row: str, values: str) -> DataFrame:
    """(row, i, value) of an array column."""
    return df.select(F.col(row).alias("row"), F.posexplode(values).alias("i", "value")).withColumn("value", F.col("value").cast("double"))


def dense(x: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """(row, j, value): sums of x(row, i) * w(i, j), plus bias(j)."""
    z = x.join(weights.withColumnRenamed("value", "w"), "i").groupBy("row", "j").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    return z.join(bias.withColumnRenamed("value", "b"), "j").select("row", "j", (F.col("z") + F.col("b")).alias("value"))


def dense_by_expression(df: DataFrame, row: str, values: str, outputs: int, weight) -> DataFrame:
    """Like ``dense`` for weights that are an expression of (i, j): one map over the array, without a shuffle."""
    x = F.transform(values, lambda v: v.cast("double"))

    def output(j: Column) -> Column:
        terms = F.transform(x, lambda v, i: v * weight(i, j))
        return F.struct(j.alias("j"), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t).alias("value"))

    out = F.transform(F.sequence(F.lit(0), F.lit(outputs - 1)), output)
    return df.select(F.col(row).alias("row"), F.inline(out))


def dense_gradients(x: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights (i, j, value), bias (j, value)): sums over rows. ``delta`` is (row, j, value)."""
    d = delta.withColumnRenamed("value", "d")
    to_weights = x.join(d, "row").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("d")).alias("value"))
    return to_weights, delta.groupBy("j").agg(F.sum("value").alias("value"))


def dense_input_delta(delta: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, i, value): sums of delta(row, j) * w(i, j)."""
    return delta.join(weights.withColumnRenamed("value", "w"), "j").groupBy("row", "i").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def softmax(z: DataFrame, index: str = "j") -> DataFrame:
    """(row, index, value), shifted by each row's maximum."""
    w = Window.partitionBy("row")
    e = z.withColumn("e", F.exp(F.col("value") - F.max("value").over(w)))
    return e.select("row", index, (F.col("e") / F.sum("e").over(w)).alias("value"))


def softmax_delta(a: DataFrame, delta: DataFrame) -> DataFrame:
    """(row, j, value): a * (delta - sum of a * delta over the row)."""
    both = a.withColumnRenamed("value", "a").join(delta.withColumnRenamed("value", "d"), ["row", "j"])
    total = F.sum(F.col("a") * F.col("d")).over(Window.partitionBy("row"))
    return both.select("row", "j", (F.col("a") * (F.col("d") - total)).alias("value"))


def _cells(df: DataFrame, height: int, width: int) -> DataFrame:
    i = F.col("i")
    return df.select("row", F.floor(i / (height * width)).alias("c"), F.floor(i / width % height).alias("r"), (i % width).alias("q"), "value")


def im2col(image: DataFrame, height: int, width: int, k: int, stride: int, padding: int) -> DataFrame:
    """(row, c, kh, kw, oy, ox, value): every cell under each window position that covers it."""
    oh, ow = (height + 2 * padding - k) // stride + 1, (width + 2 * padding - k) // stride + 1
    offsets = F.sequence(F.lit(0), F.lit(k - 1))
    spread = _cells(image, height, width).withColumn("kh", F.explode(offsets)).withColumn("kw", F.explode(offsets))
    y, x = F.col("r") + padding - F.col("kh"), F.col("q") + padding - F.col("kw")
    spread = spread.filter((y % stride == 0) & (x % stride == 0)).withColumn("oy", (y / stride).cast("long")).withColumn("ox", (x / stride).cast("long"))
    return spread.filter(F.col("oy").between(0, oh - 1) & F.col("ox").between(0, ow - 1)).select("row", "c", "kh", "kw", "oy", "ox", "value")


def conv2d(image: DataFrame, kernels: DataFrame, bias: DataFrame, height: int, width: int, k: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """(row, f, oy, ox, value). ``kernels`` is (f, c, kh, kw, value), ``bias`` (f, value)."""
    seen = im2col(image, height, width, k, stride, padding)
    z = seen.join(kernels.withColumnRenamed("value", "w"), ["c", "kh", "kw"]).groupBy("row", "f", "oy", "ox").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    return z.join(bias.withColumnRenamed("value", "b"), "f").select("row", "f", "oy", "ox", (F.col("z") + F.col("b")).alias("value"))


def conv2d_map(df: DataFrame, row: str, values: str, kernels: np.ndarray, bias: np.ndarray, height: int, width: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """Like ``conv2d`` over an array column with kernels (filters, channels, k, k) at hand: each batch of images goes
    through one matrix product where it lies, without a shuffle."""
    filters, channels, k, _ = kernels.shape
    params = np.concatenate([kernels.ravel(), bias])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # So many images at once that their cells stay small.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = part.column("values").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, channels, height, width)
                out = ConvKernel(filters, channels, k, stride, padding).forward(params, x)
                n, f, oy, ox = (i.ravel() for i in np.indices(out.shape))
                columns = [part.column("row").take(pa.array(n)), *map(pa.array, (f, oy, ox)), pa.array(out.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "f", "oy", "ox", "value"])

    rows = df.select(F.col(row).alias("row"), F.col(values).cast("array<double>").alias("values"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, f long, oy long, ox long, value double")


def conv2d_gradients(image: DataFrame, delta: DataFrame, height: int, width: int, k: int, stride: int = 1, padding: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kernels (f, c, kh, kw, value), bias (f, value)). ``delta`` is (row, f, oy, ox, value)."""
    seen = im2col(image, height, width, k, stride, padding)
    d = delta.withColumnRenamed("value", "d")
    to_kernels = seen.join(d, ["row", "oy", "ox"]).groupBy("f", "c", "kh", "kw").agg(F.sum(F.col("value") * F.col("d")).alias("value"))
    return to_kernels, delta.groupBy("f").agg(F.sum("value").alias("value"))


def col2im(delta: DataFrame, kernels: DataFrame, height: int, width: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """(row, c, r, q, value): the input's delta, scattered over the padded image and cropped."""
    spread = delta.join(kernels.withColumnRenamed("value", "w"), "f")
    r, q = F.col("oy") * stride + F.col("kh") - padding, F.col("ox") * stride + F.col("kw") - padding
    out = spread.groupBy("row", "c", r.alias("r"), q.alias("q")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return out.filter(F.col("r").between(0, height - 1) & F.col("q").between(0, width - 1))


def max_pool(image: DataFrame, height: int, width: int, k: int, stride: int, padding: int = 0) -> DataFrame:
    """(row, c, oy, ox, value, at): window maxima and the place of the last of equal maxima in its window.

    Padding counts as zeros; a window that reaches into it competes with 0 at its first padded place.
    """
    seen = im2col(image, height, width, k, stride, padding).withColumn("at", F.col("kh") * k + F.col("kw"))
    best = seen.groupBy("row", "c", "oy", "ox").agg(F.max(F.struct("value", "at")).alias("best"), F.count(F.lit(1)).alias("n"))
    padded = F.col("n") < k * k
    value = F.when(padded, F.greatest(F.col("best.value"), F.lit(0.0))).otherwise(F.col("best.value"))
    at = F.when(padded & (F.col("best.value") < 0), F.lit(None)).otherwise(F.col("best.at"))
    return best.select("row", "c", "oy", "ox", value.alias("value"), at.alias("at"))


def max_pool_delta(pooled: DataFrame, delta: DataFrame, k: int, stride: int, padding: int = 0) -> DataFrame:
    """(row, c, r, q, value): each delta at its window's maximum; what falls on padding is dropped."""
    both = pooled.drop("value").filter(F.col("at").isNotNull()).join(delta, ["row", "c", "oy", "ox"])
    r = F.col("oy") * stride + F.floor(F.col("at") / k) - padding
    q = F.col("ox") * stride + F.col("at") % k - padding
    return both.groupBy("row", "c", r.alias("r"), q.alias("q")).agg(F.sum("value").alias("value"))


def to_image(df: DataFrame, height: int, width: int) -> DataFrame:
    """(row, i, value) to (row, c, r, q, value)."""
    return _cells(df, height, width)


def to_flat(df: DataFrame, height: int, width: int) -> DataFrame:
    """(row, c, r, q, value) to (row, i, value)."""
    return df.select("row", ((F.col("c") * height + F.col("r")) * width + F.col("q")).alias("i"), "value")


def argmax(df: DataFrame, index: str = "j", last: bool = True) -> DataFrame:
    """(row, pred): the index of the largest value; of equal ones the last or the first."""
    order = F.col(index) if last else -F.col(index)
    best = df.groupBy("row").agg(F.max(F.struct("value", order.alias("o"))).alias("b"))
    return best.select("row", (F.col("b.o") if last else -F.col("b.o")).alias("pred"))
