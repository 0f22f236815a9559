"""Readers. A dataset is (row_id long, x array<float>, y array<float>)."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as c
from ..operators.partitioning import numbered

SCHEMA = "row_id long, x array<float>, y array<float>"


class DataError(ValueError):
    """A source that doesn't hold what was declared."""


def inline(spark: SparkSession, d: c.InlineDataset) -> DataFrame:
    """Two flat row-major lists."""
    x = np.array(d.samples, np.float32).reshape(-1, d.x_size).tolist()
    y = np.array(d.labels, np.float32).reshape(-1, d.y_size).tolist()
    if len(x) != len(y):
        raise DataError(f"{len(x)} rows of samples, {len(y)} of labels")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], SCHEMA)


def separator(path: str) -> str | None:
    """The field separator that an extension names; None for packed binary."""
    return {".csv": ",", ".tsv": "\t"}.get(PurePosixPath(path).suffix.lower())


#: Bytes of packed rows that one task reads, and of one Arrow batch.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a temporary one in a local session
    that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gradloom-")
    return f"{base if '://' in base else 'file://' + os.path.abspath(base)}/gradloom-{uuid.uuid4().hex}"


def packed(spark: SparkSession, path: str, width: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row_id, values): little-endian 32-bit floats without a header, ``width`` a row; of a folder all files by name.

    Tasks read byte ranges that hold whole rows, so that a row's number follows from where it stands.
    """
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    files = [info] if info.type == pafs.FileType.File else sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path)
    step, size = max(1, range_bytes // (4 * width)), 4 * width
    ranges, first = [], 0
    for f in files:
        if f.type != pafs.FileType.File or os.path.basename(f.path).startswith(("_", ".")):
            continue
        if f.size % size:
            raise DataError(f"{f.path} has {f.size} bytes, which are no whole rows of {width} floats")
        n = f.size // size
        ranges += [(f.path, at, min(step, n - at), first + at) for at in range(0, n, step)]
        first += n

    def run(batches):
        own, _ = filesystem(path)
        for batch in batches:
            for name, at, n, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with own.open_input_file(name) as source:
                    some = max(1, BATCH_BYTES // size)
                    for k in range(0, n, some):
                        m = min(some, n - k)
                        source.seek((at + k) * size)
                        values = pa.array(np.frombuffer(source.read(m * size), "<f4"))
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * width + 1, width, dtype=np.int32)), values)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row + k, row + k + m)), lists], names=["row_id", "values"])

    table = spark.createDataFrame(ranges, "path string, at long, n long, row long").repartition(max(1, len(ranges)))
    return table.mapInArrow(run, "row_id long, values array<float>")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text), lines counted from 1 over files by name. Splits count their lines side by side."""
    rows = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_at")
    )
    w = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row a split.
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return rows.join(splits, ["_file", "_start"]).select((F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "text")


def text_table(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(row_id, values) of a CSV or TSV file.

    Blank lines are skipped and fields trimmed. The first line that isn't blank is a header if any of its
    fields isn't a number. Any other field that isn't a number fails the job and names its line.
    """
    sep = separator(path)
    lines = numbered_lines(spark, path)
    full = lines.filter(F.trim("text") != "").withColumn("raw", F.transform(F.split("text", sep), lambda v: F.trim(v)))
    parsed = full.withColumn("values", F.expr("transform(raw, v -> try_cast(v AS float))"))
    first = parsed.orderBy("line").first()
    if first is None:
        raise DataError(f"{path} has no rows")
    header = first["line"] if any(v is None for v in first["values"]) else 0
    bad = F.exists("values", lambda v: v.isNull())
    checked = F.when(bad, F.raise_error(F.format_string("line %d: a field isn't a number: %s", "line", "text"))).when(
        F.size("values") != width, F.raise_error(F.format_string("line %d: %d fields, %d are needed", F.col("line"), F.size("values"), F.lit(width)))
    )
    rows = parsed.filter(F.col("line") > header).select("line", F.coalesce(checked.cast("array<float>"), F.col("values")).alias("values"))
    return numbered(rows, "line", "row_id").select("row_id", "values")


def local(spark: SparkSession, d: c.LocalDataset) -> DataFrame:
    """Samples and labels from two files, paired by row number."""
    read = lambda path, width: text_table(spark, path, width) if separator(path) else packed(spark, path, width)
    x, y = read(d.samples_path, d.x_size), read(d.labels_path, d.y_size)
    rows = x.withColumnRenamed("values", "x").join(y.withColumnRenamed("values", "y"), "row_id", "full")
    lone = F.col("x").isNull() | F.col("y").isNull()
    failed = F.raise_error(F.lit("samples and labels have different row counts"))
    return rows.select("row_id", F.when(lone, failed.cast("array<float>")).otherwise(F.col("x")).alias("x"), "y")


def from_dataframe(d: c.DataFrameDataset) -> DataFrame:
    """Columns of a DataFrame; class numbers become one-hot labels."""
    y = F.col(d.label)
    if d.classes is not None:
        y = one_hot(y, d.classes)
    return d.df.select(F.col(d.row_id).cast("long").alias("row_id"), F.col(d.features).cast("array<float>").alias("x"), y.cast("array<float>").alias("y"))


def one_hot(label, classes: int):
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def load(spark: SparkSession, d: c.InlineDataset | c.LocalDataset | c.DataFrameDataset) -> DataFrame:
    if isinstance(d, c.InlineDataset):
        return inline(spark, d)
    return local(spark, d) if isinstance(d, c.LocalDataset) else from_dataframe(d)


def count_rows(df: DataFrame, x_size: int, y_size: int) -> int:
    """Rows of a dataset, after checking the width of every row."""
    got = df.agg(F.count(F.lit(1)), F.count_if((F.size("x") != x_size) | (F.size("y") != y_size) | F.col("x").isNull() | F.col("y").isNull())).first()
    if got[1]:
        raise DataError(f"{got[1]} rows don't have {x_size} features and {y_size} labels")
    return got[0]


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` after those of ``df``."""
    first = df.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("_n"))
    # A single row.
    return df.unionByName(more.crossJoin(F.broadcast(first)).withColumn("row_id", F.col("row_id") + F.col("_n")).drop("_n"))


def subset(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by number."""
    return df.filter(F.col("row_id") < n)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark records, one JSON object a line: malformed lines and keys without ``|`` are skipped, and of each
    key only the records of the newest file (last by name) stay."""
    rows = spark.read.json(folder, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").withColumn("_file", F.col("_metadata.file_path"))
    rows = rows.filter(F.col("run_key").contains("|"))
    rows = rows.filter("_bad IS NULL").drop("_bad") if "_bad" in rows.columns else rows
    newest = rows.groupBy("run_key").agg(F.max("_file").alias("_file"))
    return rows.join(newest, ["run_key", "_file"]).drop("_file")


def _idx(spark: SparkSession, path: str, kind: str, unpack) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(lambda it: (unpack(bytes(b)) for pdf in it for b in pdf["content"]), f"row_id long, {kind}")


def idx_images(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, x): IDX images, big-endian header, pixels scaled to [0, 1]."""

    def unpack(body: bytes) -> pd.DataFrame:
        n, h, w = np.frombuffer(body, ">i4", 3, 4).tolist()
        pixels = np.frombuffer(body, np.uint8, n * h * w, 16).reshape(n, h * w).astype(np.float32) / 255
        return pd.DataFrame({"row_id": np.arange(n), "x": list(pixels)})

    return _idx(spark, path, "x array<float>", unpack)


def idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, label): IDX labels."""

    def unpack(body: bytes) -> pd.DataFrame:
        (n,) = np.frombuffer(body, ">i4", 1, 4).tolist()
        return pd.DataFrame({"row_id": np.arange(n), "label": np.frombuffer(body, np.uint8, n, 8).astype(np.int32)})

    return _idx(spark, path, "label int", unpack)
