import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gradloom.llm import bpe
from gradloom.llm.common import raw_bytes
from gradloom.llm.merging import SCAN, merge

from .conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(PATH), special_tokens={})


def encoded(texts):
    flat, cuts = bpe.tokenizer(PATH).encode(*raw_bytes(pa.array(texts)))
    return [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]


@given(st.lists(st.text(alphabet=st.sampled_from("'stmdrevl aZé1٣#\n\t\r　 🙂.S"), max_size=24), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_as_the_library_gives_them(texts):
    enc = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tokenizer(PATH).ranks, special_tokens={})
    assert encoded(texts) == [enc.encode_ordinary(t) for t in texts]


def test_every_class_of_code_point(library):
    points = [chr(c) for c in range(0, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a 1{c}1 {c}" for c in points]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_sequential_automaton():
    element, table, state, _ = bpe.automaton()
    symbols = np.random.default_rng(3).integers(0, len(element), 5000)
    fast = bpe.scan(element[symbols], table)
    at, slow = 0, []
    for s in symbols:
        slow.append(at)
        at = table[at, element[s]]
    assert fast.tolist() == slow


def test_own_merges_agree_with_the_library(library):
    r = random.Random(5)
    ranks = bpe.tokenizer(PATH).ranks
    for n in (1, 2, 7, SCAN, SCAN + 1, 300):
        piece = "".join(r.choice("abcdefgh") for _ in range(n)).encode()
        assert [ranks[p] for p in merge([piece[i : i + 1] for i in range(n)], ranks)] == library.encode_ordinary(piece.decode())


@pytest.mark.parametrize("seed", range(3))
def test_strings_merge_side_by_side_as_one_by_one(library, seed):
    r = random.Random(seed)
    alphabets = ["abcdefghijklmnop ", "aé日 🙂", "x", "theand ing", "\n\t ;.#"]
    pieces = ["".join(r.choice(alphabets[k % 5]) for _ in range(r.randrange(1, 90))).encode() for k in range(400)]
    ids, counts = bpe.tokenizer(PATH).merger.merge(pieces)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    ranks = bpe.tokenizer(PATH).ranks
    for k, piece in enumerate(pieces):
        assert [ranks[p] for p in merge([piece[i : i + 1] for i in range(len(piece))], ranks)] == ids[cuts[k] : cuts[k + 1]].tolist()
    assert bpe.tokenizer(PATH).merger.merge([])[0].tolist() == []


def test_a_token_that_merges_cannot_reach_has_its_id():
    # b+c goes first, so that a+b is out of reach; the library looks whole strings up first, too.
    ranks = {bytes([k]): k for k in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258}
    tok = bpe.Tokenizer(ranks)
    assert tok.ids([b"abc", b"abcd"]) == [np.array([258], "<i4").tobytes(), np.array([258, 100], "<i4").tobytes()]


def test_round_trip_of_awkward_rows(documents, library):
    docs = documents(AWKWARD, ids=[0, 1, 2, 3, 4, 5, 6, None, None], ids_="x", offsets="y")
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == len(AWKWARD)
    got = sorted((hashlib.sha256(bytes(r["text"])).hexdigest(), list(r["ids"])) for r in rows)
    assert got == sorted((hashlib.sha256((t or "").encode()).hexdigest(), library.encode_ordinary(t or "")) for t in AWKWARD)


def test_encode_decode_and_spans(documents):
    text = "Hello wörld, it's  fine\n\n日本"
    row = bpe.encode(documents([text]), PATH).first()
    raw, tok = text.encode(), bpe.tokenizer(PATH)
    assert row["offsets"][0] == 0
    for a, b in ((0, 5), (3, 9), (0, len(raw)), (len(raw) - 3, len(raw)), (4, 4)):
        assert bpe.span(row["ids"], row["offsets"], a, b, tok) == raw[a:b]
    back = bpe.decode(bpe.encode(documents([text, None]), PATH), PATH).orderBy("doc_id").collect()
    assert [bytes(r["text"]) for r in back] == [raw, b""]


def test_empty_table(documents):
    assert bpe.round_trip(documents([]), PATH).count() == 0
