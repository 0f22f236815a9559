"""Helpers shared by the training-data operators: scratch tables, bounded Arrow
batches, vectorised word splitting and hashing, distributed prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
#: Text bytes that one Arrow slice hands to numpy at a time, so that a worker's
#: memory follows this and not the length of a batch.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True
_ODD = 0x9E3779B97F4A7C15
#: Powers of _ODD and of its inverse modulo 2**64, grown on demand.
_POWERS = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and workers' memory, and let local Python workers import this package wherever the driver was started.

    On a cluster the package is shipped with ``--py-files``; adding the path is harmless there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    # Arrow batches are bounded by bytes, so that long texts don't add up in a worker.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    # Freed memory goes back to the system instead of staying in pools of its own.
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gradloom-")
    if "://" not in base:
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/gradloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``. Its files stay there unless the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which is off by default."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until the frame has no column of it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def any_order(df: DataFrame):
    """A hash of a row's columns, which decides where nothing else does. Columns with maps can't be hashed and are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def reading_tasks(things: int) -> int:
    """Tasks to read so many files or ranges: one each, and many each only where they are more than a driver can plan."""
    return max(1, min(things, 100_000))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of ``column``; a longer row stands alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(before, before[start] + limit, side="right")) - 1
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n+1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """_ODD ** i modulo 2**64 for i < n, or _ODD ** -i."""
    if len(_POWERS[inverse]) < n:
        p = np.full(max(n, 2 * len(_POWERS[inverse]), 1 << 16), pow(_ODD, -1, 1 << 64) if inverse else _ODD, np.uint64)
        p[0] = 1
        _POWERS[inverse] = np.multiply.accumulate(p)
    return _POWERS[inverse][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _powers(n, inverse=True)[np.minimum(starts, n - 1)]
    return mixed(spans ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and n+1 word offsets by text.

    Words never cross texts.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~_IS_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = ink[cuts]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[cuts - 1] = ink[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows and n+1 window offsets by text.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    counts = np.diff(word_offsets)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n)])
    if offsets[-1] == 0:
        return np.zeros(0, np.uint64), offsets
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(offsets[-1]) - offsets[text] + word_offsets[text]
    end = word_offsets[text + 1]
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        inside = at + j < end
        h = np.where(inside, hashes[np.minimum(at + j, len(hashes) - 1)], np.uint64(0))
        out = out * np.uint64(_ODD) + h
    return mixed(out), offsets


def distinct(body: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans of ``body`` and, for each span, its place among them. Spans must follow each other without gaps."""
    cuts = np.append(starts, ends[-1:]).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(body)])
    coded = spans.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


class Memory:
    """A bounded mapping of two generations: when the younger is full it becomes the older one, so that what
    is used often stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, zero for empty texts."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return before[offsets[1:]] - before[offsets[:-1]]
