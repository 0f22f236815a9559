import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest

from gradloom.llm import warc

SCHEMA = "page_id long, url string, html string, size long, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)


def expected(rows, least=0):
    best = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page is not None:
            best[body] = max(best.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = body in best and page != best[body]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", best[body] if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (3, None, None), (4, "u\r\nX: y", ""), (5, "é", "日本" * 40_000), (-6, "", "<p>x"), (7, "z", "\x1f\x8b\x08 WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = warc.round_trip(pages(spark, ROWS).repartition(3), least).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, least)


def test_empty_table_and_repeated_rows(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    rows = [(1, "a", "x"), (1, "a", "x"), (0, "a", "x"), (None, "n", "x")]
    got = sorted((tuple(r)[0], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, rows)).collect() if r["page_id"] is not None)
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def archive(n):
    members = [warc.record(k, f"http://x/{k}", bytes([k % 251]) * (k * 37 % 5000), "D", k) for k in range(n)]
    return b"".join(members), members


@pytest.mark.parametrize("split", [1, 97, 1000, 10**7])
def test_every_split_owns_the_records_that_start_in_it(split):
    body, members = archive(60)
    reader = warc.Reader(pa.BufferReader(body), len(body))
    found = [(at, rec) for start in range(0, len(body), split) for at, rec in reader.records(start, min(len(body), start + split))]
    assert [rec for _, rec in found] == [gzip.decompress(m) for m in members]
    assert [at for at, _ in found] == [sum(map(len, members[:k])) for k in range(len(members))]


def test_false_magic_is_passed_over():
    good = warc.record(1, "u", b"p", "D", 1)
    other = gzip.compress(b"not an archive record\r\n\r\n")
    body = warc.MAGIC + b"junk" + other + good + warc.MAGIC
    reader = warc.Reader(pa.BufferReader(body), len(body))
    assert [rec for _, rec in reader.records(0, len(body))] == [gzip.decompress(good)]


def test_a_cut_archive_is_an_error():
    body = warc.record(1, "u", bytes(range(256)) * 50, "D", 1)[:-20]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.Reader(pa.BufferReader(body), len(body)).records(0, len(body)))


def test_records_read_as_the_format_says():
    headers, http, payload = warc.parsed(gzip.GzipFile(fileobj=io.BytesIO(warc.record(9, "http://q", b"body", "ABC", 4))).read())
    assert headers["warc-type"] == "response" and headers["warc-payload-digest"] == "sha1:ABC"
    assert http["content-length"] == "4" and payload == b"body"


def test_long_headers_are_read(spark):
    rows = [(1, "http://a", "<p>x"), (2, "data:," + "".join(f"{k:07d}" for k in range(14_300)), "<p>y"), (3, "data:," + "\x01" * 40_000, "<p>x"), (4, "http://b", "<p>z")]
    got = warc.round_trip(pages(spark, rows).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_every_range_is_read_by_a_task_of_its_own(spark):
    rows = [(k, f"http://a/{k}", "".join(f"{x:05x}" for x in range(k * 100, k * 100 + 400))) for k in range(60)]
    files = warc.write(pages(spark, rows).repartition(3))
    ranges = sum(-(-r["bytes"] // 2000) for r in files.collect())
    back = warc.read(files, 2000)
    assert back.rdd.getNumPartitions() == ranges > 20
    assert sorted(r["record_id"] for r in back.select("record_id").collect()) == sorted(warc.record_urn(k) for k in range(60))


def test_a_repeated_write_replaces_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    one = warc.write(pages(spark, ROWS), folder)
    paths = {r["path"] for r in one.collect()}
    two = warc.write(pages(spark, ROWS[:2]), folder)
    assert not paths & {r["path"] for r in two.collect()} and warc.read(two).count() == 2


def test_clashing_names(spark):
    rows = [(1, "a", "x", "p", 5, "q"), (2, "b", "x", "p", 5, "q")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, id string, size int, best string").selectExpr("*", "'z' AS sha1", "1 AS revisit", "2 AS refers_to", "3 AS n")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(docs).collect()) == [(1, "revisit", 2), (2, "response", None)]
