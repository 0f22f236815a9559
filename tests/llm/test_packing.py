import hashlib
import io

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gradloom.llm import bpe, packing

from .conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def best_fit_decreasing(lengths, row):
    """Rows by a plain search for the fullest one with room."""
    free = []
    for n in sorted(lengths, reverse=True):
        room = [f for f in free if f >= n]
        if room:
            k = free.index(min(room))
            free[k] -= n
        else:
            free.append(row - n)
    return len(free)


@given(st.lists(st.integers(0, 25), max_size=60), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_packing(lengths, row):
    rows, _ = packing.pack(np.array(lengths, np.int64), row)
    assert all(sum(n for *_, n in r) <= row for r in rows)
    seen = {}
    for r in rows:
        for doc, part, first, n in r:
            seen.setdefault(doc, []).append((part, first, n))
    for doc, n in enumerate(lengths):
        parts = sorted(seen.get(doc, []))
        assert [p for p, _, _ in parts] == list(range(-(-n // row)))
        assert [(f, k) for _, f, k in parts] == [(a, min(row, n - a)) for a in range(0, n, row)]
    rest = [n % row for n in lengths if n % row]
    assert len(rows) == sum(n // row for n in lengths) + best_fit_decreasing(rest, row)


@given(st.lists(st.integers(0, 40), max_size=30))
@settings(max_examples=100, deadline=None)
def test_blocks_come_back(lengths):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.arange(offsets[-1]).astype("<u2")
    body, rows = packing.to_bytes(flat, offsets, 16, "<u2")
    source = io.BytesIO(body)
    block = packing.read_block(source)
    assert packing.read_block(source) is None and len(block.counts) == rows
    ids, cuts = block.document_ids()
    assert ids.tolist() == flat.tolist() and cuts.tolist() == offsets.tolist()
    for k in range(rows):
        cuts = block.cumulative(k)
        want = np.zeros(16, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            want[a:b] = np.arange(b - a)
        assert cuts[0] == 0 and (block.positions(k) == want).all()


def test_rows_come_back(documents):
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(PATH), special_tokens={})
    docs = documents(AWKWARD, ids=[0, 1, 2, 3, 4, 5, 6, None, None], file="x", n_tokens="y")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_segments"], r["ids_sha256"]) for r in packing.round_trip(docs, PATH, row=64).collect())
    ids = [library.encode_ordinary(t or "") for t in AWKWARD]
    keys = [0, 1, 2, 3, 4, 5, 6, None, None]
    assert got == sorted((str(k), len(x), -(-len(x) // 64), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for k, x in zip(keys, ids, strict=True))


def test_every_shard_is_read_by_a_task_of_its_own_and_runs_agree(documents):
    docs = documents([f"some words of text {k} " * (k % 9) for k in range(120)]).repartition(6)
    manifest = packing.write(docs, PATH, row=32)
    assert packing.read(manifest).rdd.getNumPartitions() == 6
    one, two = (sorted(map(tuple, packing.round_trip(docs, PATH, row=32).collect())) for _ in range(2))
    assert one == two and all(r[-1] for r in one)


def test_wrong_resets_are_seen():
    body, _ = packing.to_bytes(np.arange(50).astype("<u2"), np.array([0, 20, 50]), 16, "<u2")
    block = packing.read_block(io.BytesIO(body))
    assert (block.resets == block.starts()).all()
    block.resets[1] += 1
    assert (block.resets == block.starts()).sum() == len(block.resets) - 1


def test_empty_table(documents):
    assert packing.round_trip(documents([]), PATH).count() == 0


def test_not_a_block():
    with pytest.raises(ValueError, match="not a packed block"):
        packing.read_block(io.BytesIO(b"x" * 64))
