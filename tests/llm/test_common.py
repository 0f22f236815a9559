import re

import numpy as np
import pyarrow as pa

from gradloom.llm.common import Memory, any_order, distinct, fresh, raw_bytes, shingles, slices, span_hashes, sums_by_text, words

TEXTS = ["ab cd ab", "", None, "  ab\x0bcd ", "é ab", "one two three four five six"]


def test_words_match_the_pattern():
    data, offsets = raw_bytes(pa.array(TEXTS))
    starts, ends, by_text = words(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert by_text.tolist() == [0, 3, 3, 3, 5, 7, 13]


def test_span_hashes_depend_on_bytes_alone():
    data, offsets = raw_bytes(pa.array(TEXTS))
    starts, ends, _ = words(data, offsets)
    h = dict(zip([bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)], span_hashes(data, starts, ends).tolist(), strict=True))
    other, cuts = raw_bytes(pa.array(["zz ab and much more é"]))
    s, e, _ = words(other, cuts)
    again = dict(zip([bytes(other[a:b]) for a, b in zip(s, e, strict=True)], span_hashes(other, s, e).tolist(), strict=True))
    assert h[b"ab"] == again[b"ab"] and h["é".encode()] == again["é".encode()]
    assert len(set(h.values())) == len(h)


def test_shingles_of_short_texts_are_whole():
    data, offsets = raw_bytes(pa.array(TEXTS))
    starts, ends, by_text = words(data, offsets)
    grams, cuts = shingles(span_hashes(data, starts, ends), by_text, 5)
    assert np.diff(cuts).tolist() == [1, 0, 0, 1, 1, 2]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    parts = list(slices(batch, limit=20))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()
    assert max(sum(len(x or "") for x in p.column("text").to_pylist()) for p in parts if p.num_rows > 1) <= 20


def test_distinct_and_sums():
    kinds, place = distinct(b"abcabc", np.array([0, 3]), np.array([6]))
    assert kinds == [b"abc"] and place.tolist() == [0, 0]
    assert sums_by_text(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 3]


def test_memory_keeps_what_is_used():
    m = Memory(2)
    m.put("a", 1)
    m.put("b", 2)
    m.put("c", 3)
    assert m.get("a") == 1
    m.put("d", 4)
    m.put("e", 5)
    assert m.get("a") == 1 and m.get("b") is None


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, {"a": 1})], "ID int, id_ map<string,int>")
    assert fresh(df, "id", "id", "x") == ["id__", "id___", "x"]
    assert df.select(any_order(df)).first()[0] is not None
