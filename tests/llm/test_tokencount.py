import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gradloom.llm import tokencount
from gradloom.llm.common import raw_bytes

from .conftest import AWKWARD

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def counts(texts):
    return tokencount.counter(PATH).counts(*raw_bytes(pa.array(texts, pa.string()))).tolist()


@given(st.lists(st.text(alphabet=st.sampled_from("  abtheE\n\t▁é\x00\r;日🙂<s>1.ﬁ"), max_size=24), max_size=8))
@settings(max_examples=200, deadline=None)
def test_counts_as_the_library_gives_them(texts):
    assert counts(texts) == [len(x) for x in LIBRARY.encode(texts, num_threads=1)]


def test_whole_tokens_are_proved():
    known = tokencount.counter(PATH)
    assert known.cuts_at_spaces
    for piece in list(known.whole)[:: len(known.whole) // 300]:
        text = piece.decode()
        # A leading space is what the library adds itself.
        if text.startswith(" ") and len(text) > 1:
            assert len(LIBRARY.encode(text[1:])) == 1


def test_unreachable_pieces_are_not_whole():
    known = tokencount.Counter({"a": -1.0, "b": -2.0, "c": -3.0, "abc": -4.0})
    assert b"abc" not in known.whole and known.count(b"abc") == 3


def test_awkward_rows(documents):
    docs = documents(AWKWARD, n_bytes="x", n_tokens="y")
    rows = tokencount.token_counts(docs, PATH, limit=100).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [len(LIBRARY.encode(t or "")) for t in AWKWARD]
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in AWKWARD]
    assert [r["over_limit"] for r in rows] == [r["n_tokens"] > 100 for r in rows]


def test_empty_table(documents):
    assert tokencount.token_counts(documents([]), PATH).count() == 0


def message(*fields):
    """A protocol buffer message of (number, whole number or bytes)."""
    out = b""
    for number, value in fields:
        out += bytes([number * 8 % 128 + 128, number // 16]) if number > 15 else b""
        if isinstance(value, int):
            out += (b"" if number > 15 else bytes([number * 8])) + bytes([value])
        else:
            out += bytes([number * 8 + 2, len(value)]) + value
    return out


def test_models_of_other_rules_are_refused():
    plain = [(1, message((1, b"a"))), (2, message((3, 2))), (3, message((4, 0)))]
    tokencount.refuse_others(message(*plain))
    with open(PATH, "rb") as f:
        tokencount.refuse_others(f.read())
    others = {
        "BPE": [plain[0], (2, message((3, 1))), plain[2]],
        "behind": [plain[0], (2, message((3, 2), (24, 1))), plain[2]],
        "maps": [*plain[:2], (3, message((2, b"x"), (4, 0)))],
        "leading": [*plain[:2], (3, message((3, 0), (4, 0)))],
        "removes": [*plain[:2], (3, message((5, 1)))],
        "unmarked": [*plain[:2], (3, message((4, 0), (5, 0)))],
        "users": [(1, message((1, b"a"), (3, 4))), *plain[1:]],
    }
    for word, fields in others.items():
        with pytest.raises(ValueError, match=word):
            tokencount.refuse_others(message(*fields))


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "\n" * 300])
def test_long_pre_tokens(text):
    assert counts([text]) == [len(LIBRARY.encode(text))]
