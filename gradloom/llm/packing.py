"""Packing token ids into rows of a fixed length.

Each task packs the documents of its own partition, so that nothing is
shuffled. Documents longer than a row are split without loss: full rows first,
then the rest. Pieces are placed best-fit decreasing: longest first, each into
the fullest row that still has room, found by a segment tree over free
capacities. Rows are written as little-endian id matrices with the cumulative
lengths of their segments and the places at which position ids start anew.

A shard is a file of blocks, each a header and five arrays: ids (uint16 or
uint32), segment counts of rows, cumulative segment lengths (from 0, row after
row), position resets (the flat place in the matrix at which each segment
starts), and document number and part of every segment. Padding has id 0 and
belongs to no segment.

Documents wait in memory for at most ``block_tokens`` tokens before they are
packed and written, whatever the size of the partition.

Defined cases: documents without tokens (null or empty text) have no segment
and come back with zero tokens; null ids and repeated rows are packed like any
other, told apart by their place in the block; very long texts are encoded whole
and split over rows; an empty table writes empty shards; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import reading_tasks, shared_dir, slices, stored
from .warc import _filesystem

#: Tokens of a row, and tokens that are packed together.
ROW_TOKENS, BLOCK_TOKENS = 2048, 2 << 20
_HEAD = struct.Struct("<4sIIIIQ")
_MARK = b"PACK"


class Capacities:
    """A segment tree that finds the row whose free capacity is smallest but enough.

    Leaf c counts open rows with exactly c tokens free; inner nodes hold sums, so that the next used
    capacity from c upwards is found in logarithmic time.
    """

    def __init__(self, most: int):
        self.width = 1 << int(most).bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def _count(self, free: int, by: int) -> None:
        k = free + self.width
        while k:
            self.tree[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of the fullest row with room for ``need``, removed from the tree."""
        k = need + self.width
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        free = k - self.width
        self._count(free, -1)
        return free, self.rows[free].pop()


def pack(lengths: np.ndarray, row: int) -> tuple[list[list[tuple[int, int, int, int]]], int]:
    """Rows of segments (document, part, first token, tokens), and how many pieces overlong documents became."""
    full, pieces, split = [], [], 0
    for doc, n in enumerate(lengths.tolist()):
        whole, rest = divmod(n, row)
        full += [[(doc, p, p * row, row)] for p in range(whole)]
        split += whole + (rest > 0) if n > row else 0
        if rest:
            pieces.append((rest, doc, whole))
    pieces.sort(key=lambda x: (-x[0], x[1]))
    rows, free = [], Capacities(row)
    for n, doc, part in pieces:
        found = free.take(n)
        if found is None:
            rows.append([(doc, part, part * row, n)])
            found = row, len(rows) - 1
        else:
            rows[found[1]].append((doc, part, part * row, n))
        if found[0] > n:
            free.add(found[0] - n, found[1])
    return full + rows, split


@dataclass
class Block:
    """Packed rows as read back: ids (rows, row length), segment counts of rows, cumulative lengths, resets and
    (document, part) of segments, and the number of documents."""

    ids: np.ndarray
    counts: np.ndarray
    lengths_by_row: np.ndarray
    resets: np.ndarray
    segments: np.ndarray
    documents: int

    def cumulative(self, k: int) -> np.ndarray:
        """Cumulative segment lengths of row k, from 0."""
        end = int(np.sum(self.counts[: k + 1])) + k + 1
        return self.lengths_by_row[end - self.counts[k] - 1 : end]

    def positions(self, k: int) -> np.ndarray:
        """Position ids of row k: from 0 in each segment, and 0 in the padding."""
        out = np.zeros(self.ids.shape[1], np.int32)
        cuts = self.cumulative(k)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = np.arange(b - a)
        return out

    def lengths(self) -> np.ndarray:
        """Tokens of each segment."""
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.arange(len(self.segments)) + row
        return self.lengths_by_row[at + 1] - self.lengths_by_row[at]

    def starts(self) -> np.ndarray:
        """The flat place of each segment, by the cumulative lengths."""
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        return row * self.ids.shape[1] + self.lengths_by_row[np.arange(len(self.segments)) + row]

    def document_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents end to end in order of document and part, n+1 offsets)."""
        lengths = self.lengths()
        order = np.lexsort((self.segments[:, 1], self.segments[:, 0]))
        n = lengths[order]
        at = np.repeat(self.resets[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sizes = np.bincount(self.segments[:, 0], lengths, self.documents).astype(np.int64)
        return self.ids.ravel()[at], np.concatenate([[0], np.cumsum(sizes)])


def to_bytes(flat: np.ndarray, offsets: np.ndarray, row: int, dtype: str) -> tuple[bytes, int]:
    """A block of packed documents, and its rows."""
    rows, _ = pack(np.diff(offsets), row)
    ids = np.zeros((len(rows), row), dtype)
    segments, cumulative, resets = [], [], []
    for k, own in enumerate(rows):
        at = 0
        cumulative.append(0)
        for doc, part, first, n in own:
            ids[k, at : at + n] = flat[offsets[doc] + first : offsets[doc] + first + n]
            segments.append((doc, part))
            resets.append(k * row + at)
            at += n
            cumulative.append(at)
    counts = np.array([len(r) for r in rows], "<u4")
    head = _HEAD.pack(_MARK, len(rows), row, ids.dtype.itemsize, len(offsets) - 1, len(segments))
    arrays = ids, counts, np.array(cumulative, "<u4"), np.array(resets, "<u8"), np.array(segments, "<u4")
    return head + b"".join(a.tobytes() for a in arrays), len(rows)


def read_block(source) -> Block | None:
    """The next block of a file, None at its end."""
    head = source.read(_HEAD.size)
    if not head:
        return None
    mark, rows, row, width, documents, segments = _HEAD.unpack(head)
    if mark != _MARK:
        raise ValueError("not a packed block")
    take = lambda n, kind: np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
    ids = take(rows * row, f"<u{width}").reshape(rows, row)
    counts, cumulative, resets, table = take(rows, "<u4"), take(segments + rows, "<u4"), take(segments, "<u8"), take(2 * segments, "<u4")
    whole = lambda a: a.astype(np.int64)
    return Block(ids, whole(counts), whole(cumulative), whole(resets), whole(table).reshape(-1, 2), documents)


def write(docs: DataFrame, path: str, folder: str | None = None, row: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and pack; returns (file, block, place, id, n_tokens) of every document, already written beside the shards.

    ``place`` is the document's number within its block. A file's name is its task attempt's own and counts only
    through the manifest, so that a repeated task, whose rows may come in another order, can't mix with the first.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/packed"
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        tok = bpe.tokenizer(path)
        dtype = "<u2" if len(tok.sizes) <= 1 << 16 else "<u4"
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        block, flats, sizes, ids, held = 0, [], [], [], 0
        with fs.open_output_stream(f"{root}/{name}") as out:

            def flush() -> pa.RecordBatch:
                counts = np.concatenate(sizes)
                body, _ = to_bytes(np.concatenate(flats), np.concatenate([[0], np.cumsum(counts)]), row, dtype)
                out.write(body)
                n = len(counts)
                columns = [pa.array([name] * n, pa.string()), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32))]
                return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(ids), pa.array(counts)], names=["file", "block", "place", "id", "n_tokens"])

            for batch in batches:
                for part in slices(batch, text_col):
                    flat, by_text, _ = bpe.encode_slice(part, text_col, tok)
                    flats.append(flat.astype(dtype))
                    sizes.append(np.diff(by_text))
                    ids.append(part.column(id_col))
                    held += len(flat)
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        block, flats, sizes, ids, held = block + 1, [], [], [], 0
            if sizes:
                yield flush()

    manifest = rows.mapInArrow(run, f"file string, block int, place int, id {kind}, n_tokens long")
    return stored(manifest.withColumn("folder", F.lit(folder)), f"{folder}-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read the shards back: (file, block, place, n_tokens, n_segments, ids_sha256, resets_ok) of every document, its ids put
    together again from the matrices; the hash is over little-endian 32-bit ids; resets_ok says whether the position resets
    of all its segments stand where the cumulative lengths of their rows do."""
    shards = manifest.select("folder", "file").distinct()
    # A shard is a small row that stands for many bytes: the number of tasks is given, so that nothing joins shards.
    shards = shards.repartition(reading_tasks(shards.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = _filesystem(folder)
                with fs.open_input_file(f"{root}/{name}") as source:
                    k = 0
                    while (block := read_block(source)) is not None:
                        flat, offsets = block.document_ids()
                        body, n = flat.astype("<u4").tobytes(), block.documents
                        hashes = [hashlib.sha256(body[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]  # noqa: B905
                        parts = np.bincount(block.segments[:, 0], minlength=n)
                        wrong = np.bincount(block.segments[:, 0], block.resets != block.starts(), n) > 0
                        columns = [np.full(n, k, np.int32), np.arange(n, dtype=np.int32), np.diff(offsets), parts.astype(np.int64)]
                        names = ["file", "block", "place", "n_tokens", "n_segments", "ids_sha256", "resets_ok"]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *map(pa.array, columns), pa.array(hashes), pa.array(~wrong)], names=names)
                        k += 1

    return shards.mapInArrow(run, "file string, block int, place int, n_tokens long, n_segments long, ids_sha256 string, resets_ok boolean")


def round_trip(docs: DataFrame, path: str, row: int = ROW_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """Pack, write, read back; one row per document: id, n_tokens, n_segments, ids_sha256, resets_ok. Where a document lies
    follows from the partitioning and the task attempt and is left to the manifest."""
    manifest = write(docs, path, row=row, id_col=id_col)
    found = read(manifest).drop("n_tokens")
    # The planner takes the documents read back for as few rows as there are shards; the hint keeps it from broadcasting them.
    out = manifest.drop("folder").join(found.hint("merge"), ["file", "block", "place"])
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_segments", "ids_sha256", "resets_ok")
