"""WARC archives: writer with payload deduplication and a splittable reader.

Writing: every page becomes one record in its own gzip member. Of pages with
equal payloads (by SHA-1 and length) the one with the largest id is a
``response``; the others are ``revisit`` records that carry only the HTTP
header and refer to it. Each task attempt writes one archive under a name of
its own, which counts only through the manifest, so that a retried or
speculative task can't mix with the first.

Reading: archives are cut into byte ranges, one task each. A task looks for the
gzip magic in its range, takes a position as a record if the member there
decodes to a WARC version line and complete headers, and owns the records that
start inside its range, following member after member and reading past the
range's end for the last one. False magics inside compressed data fail to
decode and are passed over.

Files are reached through ``pyarrow.fs`` (local, HDFS, S3, GCS), under the
shared folder of the session unless a path is given.

Defined cases: null html is an empty payload; null urls give an empty target;
control characters in urls are percent-encoded; small payloads (below
``least_bytes``) are always responses; a null id is smaller than any other
when a response is chosen; rows that repeat the id and payload of a response
are responses as well; very long payloads are written and read whole, one at a
time; an empty table writes empty archives and reads no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reading_tasks, shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one reading task owns.
SPLIT_BYTES = 16 << 20
#: Bytes fetched at a time.
BLOCK = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _safe(value: str) -> str:
    return "".join(c if 32 <= ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member. A revisit's block is the HTTP header alone; its Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _safe(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    # No time stamp, so that a retried task writes the same bytes.
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, size, refers_to): refers_to is a struct of the response's id for revisits, else null.

    The largest id of each digest is aggregated before the join; hot digests in the join are split by adaptive execution.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    best = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(best.filter("n > 1").select("sha1", "size", "best"), ["sha1", "size"], "left")
    again = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    return joined.select("id", "url", "payload", "size", again.alias("revisit"), F.when(again, F.col("best")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write archives; returns (path, bytes, records) of each, already written."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        total = n = 0
        with fs.open_output_stream(name, compression=None) as out:
            for batch in batches:
                columns = [batch.column(c) for c in ("id", "url", "payload", "size", "revisit", "refers_to")]
                for k in range(batch.num_rows):
                    page, url, payload, size, revisit, refers = (c[k].as_py() for c in columns)
                    member = record(page, url, payload, base32_sha1(payload), size, refers, revisit)
                    out.write(member)
                    total, n = total + len(member), n + 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{os.path.basename(name)}"], "bytes": [total], "records": [n]})

    manifest = deduplicated(pages, **columns).mapInArrow(run, "path string, bytes long, records long")
    return stored(manifest, f"{folder.rstrip('/')}-manifest")


class Reader:
    """Records of one archive by byte range."""

    def __init__(self, source: pa.NativeFile, size: int):
        self.source, self.size = source, size

    def at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(max(0, min(n, self.size - start)))

    def first(self, start: int, end: int) -> int | None:
        """The first position in [start, end) at which a record starts."""
        at = start
        while at < end:
            block = self.at(at, min(BLOCK, end - at) + len(MAGIC) - 1)
            k = block.find(MAGIC)
            while k >= 0:
                if at + k < end and self.valid(at + k):
                    return at + k
                k = block.find(MAGIC, k + 1)
            at += BLOCK
        return None

    def valid(self, start: int) -> bool:
        """Whether the member decodes to a version line and whole headers, however long these are."""
        unpack = zlib.decompressobj(31)
        head, at = bytearray(), start
        try:
            while not unpack.eof and at < self.size:
                chunk = self.at(at, 4096)
                at += len(chunk)
                seen = max(len(head) - 3, 0)
                head += unpack.decompress(chunk)
                if not head.startswith(b"WARC/"[: len(head)]):
                    return False
                if (end := head.find(b"\r\n\r\n", seen)) >= 0:
                    return head.find(b"\r\nContent-Length:", 0, end) >= 0 and head.find(b"\r\nWARC-Type:", 0, end) >= 0
        except zlib.error:
            pass
        return False

    def member(self, start: int) -> tuple[bytes, int]:
        """The whole record at ``start`` and where its member ends."""
        unpack = zlib.decompressobj(31)
        out, at = [], start
        while not unpack.eof:
            chunk = self.at(at, 64 << 10)
            if not chunk:
                raise ValueError(f"archive ends inside the record at byte {start}")
            at += len(chunk)
            out.append(unpack.decompress(chunk))
        return b"".join(out), at - len(unpack.unused_data)

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(position, record) of all records that start in [start, end)."""
        at = self.first(start, end)
        while at is not None and at < end:
            body, after = self.member(at)
            yield at, body
            # Members follow each other; after a gap the search goes on.
            at = after if after < end and self.at(after, 3) == MAGIC and self.valid(after) else self.first(after, end)


def parsed(body: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of a record."""
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(warc.get("content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Read archives named in ``files`` (path, bytes).

    One row per record: path, offset, record_type, target_uri, record_id, refers_to, payload_digest, payload_bytes, payload.
    """
    last = F.greatest(F.ceil(F.col("bytes") / split_bytes) - 1, F.lit(0))
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    # Ranges are small rows that stand for many bytes: their number of tasks is given, so that nothing joins them.
    n = files.filter("bytes > 0").agg(F.sum(last + 1)).first()[0] or 0
    ranges = ranges.repartition(reading_tasks(int(n)))
    schema = "path string, offset long, record_type string, target_uri string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)  # noqa: E731, B905
        names = [f.split()[0] for f in schema.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    start = row["k"] * split_bytes
                    for at, body in Reader(source, row["bytes"]).records(start, min(row["bytes"], start + split_bytes)):
                        warc, http, payload = parsed(body)
                        size = int(http.get("content-length", len(payload))) if warc["warc-type"] == "revisit" else len(payload)
                        digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                        if warc["warc-type"] == "response":
                            digest = base32_sha1(payload)
                        out.append((row["path"], at, warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-record-id"), warc.get("warc-refers-to"), digest, size, payload))
                        held += len(payload)
                        if held > BLOCK or len(out) >= 1000:
                            yield flush()
                            out, held = [], 0
        if out:
            yield flush()

    return ranges.mapInArrow(run, schema)


def page_of(urn):
    """The page id inside a record's name, null for one without."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, read back; one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read(write(pages, least_bytes=least_bytes))
    return back.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
