"""Byte-level BPE encoding and decoding.

Pre-tokens are located without a regex. Every code point becomes a class from a
table; class, look-ahead and text start make a symbol, and each symbol is a
transition function on the eight states of a small automaton. The functions
generated by the symbols are closed under composition (a finite monoid), so the
state before every position comes from an associative scan over one composition
table. A pre-token starts where the state and the symbol say so. The slices
then go through pair merging, side by side and once per distinct slice and
worker.

Encoded rows carry the byte offset of every token, so that decoding can give
back any span of the text, not only the whole.

Defined cases: a null text counts as empty and has no tokens; null ids and
repeated rows pass through; very long texts are processed whole, in slices of
their own; an empty table gives no rows; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, distinct, raw_bytes, release_memory, slices
from .merging import PairMerger

#: Distinct pre-tokens in each of the two generations that a worker remembers, about 200 bytes each.
CACHE = 150_000

# Classes of code points.
_LETTER, _NUMBER, _OTHER, _QUOTE, _BLANK, _WHITE = range(6)
#: The code points with the White_Space property.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as a contraction, of one and of two letters.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

#: Letters and numbers of Unicode 16, first and last code point, which Python's older tables lack.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

# States: what the open pre-token is after a character.
_IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _IN_WHITE, _JOINS, _CLOSED, _ONE_LEFT, _TWO_LEFT = range(8)
# Symbols; those for the first character of a text follow, FIRST further on.
_S_LETTER, _S_NUMBER, _S_OTHER, _S_SHORT, _S_LONG, _S_WHITE, _S_LAST_BLANK, _S_LAST_WHITE = range(8)
_FIRST = 8


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)])
    out[kinds == "L"] = _LETTER
    out[kinds == "N"] = _NUMBER
    for ranges, kind in ((NEWER_LETTERS, _LETTER), (NEWER_NUMBERS, _NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE)] = _WHITE
    out[0x20] = _BLANK
    out[0x27] = _QUOTE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character and whether a pre-token starts at it."""
    if state == _TWO_LEFT:
        return _ONE_LEFT, False
    if state == _ONE_LEFT:
        return _CLOSED, False
    run = {_S_LETTER: _IN_LETTERS, _S_NUMBER: _IN_NUMBERS}.get(symbol, _IN_OTHERS)
    if symbol in (_S_LETTER, _S_NUMBER, _S_OTHER):
        return run, state not in (run, _JOINS)
    if symbol in (_S_SHORT, _S_LONG):
        if state in (_IN_OTHERS, _JOINS):
            return _IN_OTHERS, False
        return (_ONE_LEFT if symbol == _S_SHORT else _TWO_LEFT), True
    if symbol == _S_WHITE:
        return _IN_WHITE, state != _IN_WHITE
    # The last white space before something else always starts anew.
    return (_JOINS if symbol == _S_LAST_BLANK else _CLOSED), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, composition table of the monoid, state that each element
    leads to from a closed start, and starts by (state, symbol)."""
    symbols = range(2 * _FIRST)
    move = [tuple(_step(_CLOSED if s >= _FIRST else q, s % _FIRST)[0] for q in range(8)) for s in symbols]
    start = np.array([[_step(_CLOSED if s >= _FIRST else q, s % _FIRST)[1] for s in symbols] for q in range(8)])
    elements: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    for f in move:
        elements.setdefault(f, len(elements))
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in move:
            h = tuple(g[q] for q in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    funcs = list(elements)
    table = np.array([[elements[tuple(g[q] for q in f)] for g in funcs] for f in funcs], np.uint16)
    return np.array([elements[f] for f in move], np.uint16), table, np.array([f[_CLOSED] for f in funcs], np.uint8), start


def scan(elements: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exclusive prefix compositions: out[i] = e[0] then e[1] ... then e[i-1].

    Blocks are composed side by side, their totals scanned in turn, and the blocks run again from there.
    """
    n = len(elements)
    if n <= 64:
        out = np.zeros(n, np.uint16)
        for i in range(1, n):
            out[i] = table[out[i - 1], elements[i - 1]]
        return out
    width = 1 << max(3, int(n).bit_length() // 2 - 2)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat, size = table.ravel(), np.uint32(table.shape[1])
    total = np.zeros(rows, np.uint16)
    for column in columns:
        total = flat[total * size + column]
    state = scan(total, table)
    out = np.empty_like(columns)
    for k, column in enumerate(columns):
        out[k] = state
        state = flat[state * size + column]
    return out.T.ravel()[:n]


def _symbols(points: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    n = len(points)
    white = kind >= _BLANK
    out = np.array([_S_LETTER, _S_NUMBER, _S_OTHER, _S_OTHER, _S_WHITE, _S_WHITE], np.uint8)[kind]
    followed = np.zeros(n, bool)
    followed[:-1] = ~white[1:]
    followed[lasts] = False
    out[(kind == _BLANK) & followed] = _S_LAST_BLANK
    out[(kind == _WHITE) & followed] = _S_LAST_WHITE
    quotes = np.flatnonzero(kind == _QUOTE)
    if len(quotes):
        # Code points after each apostrophe, zero beyond its text's end.
        end = lasts[np.searchsorted(lasts, quotes)]
        one = np.where(quotes + 1 <= end, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= end, points[np.minimum(quotes + 2, n - 1)], 0)
        out[quotes[np.isin(one, [ord(c) for c in SHORT])]] = _S_SHORT
        for a, b in LONG:
            out[quotes[(one == ord(a)) & (two == ord(b))]] = _S_LONG
    out[firsts] += _FIRST
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start, over texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    begins = offsets[:-1][np.diff(offsets) > 0]
    firsts = np.searchsorted(lead, begins)
    lasts = np.append(firsts[1:], len(points)) - 1
    symbols = _symbols(points, firsts, lasts)
    element, table, state, start = automaton()
    before = state[scan(element[symbols], table)]
    return lead[start[before, symbols]]


class Tokenizer:
    """Ranks of byte strings; a pre-token that is a token has its id, the ids of others are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.merger = PairMerger(ranks)
        self.memory = Memory(CACHE)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit integers."""
        whole, known = self.whole.get, self.memory.get
        out = [whole(p) or known(p) for p in pieces]
        new = [k for k, packed in enumerate(out) if packed is None]
        if new:
            found, counts = self.merger.merge([pieces[k] for k in new])
            body, ends = found.astype("<i4").tobytes(), np.cumsum(4 * counts).tolist()
            for k, start, end in zip(new, [0, *ends], ends):  # noqa: B905
                out[k] = body[start:end]
                if len(pieces[k]) <= 256:
                    self.memory.put(pieces[k], out[k])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the n+1 offsets of the texts in them."""
        starts = boundaries(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        pieces, place = distinct(data, starts, np.array([len(data)]))
        known = self.ids(pieces)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        first = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(sizes[place])])
        flat = np.frombuffer(b"".join(known), "<i4")
        at = np.repeat(first[place] - before[:-1], sizes[place]) + np.arange(before[-1])
        return flat[at], before[np.searchsorted(starts, offsets)]

    @property
    def sizes(self) -> np.ndarray:
        """Bytes of each id."""
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.vocabulary, default=-1) + 1, np.int64)
            for k, v in self.vocabulary.items():
                self._sizes[k] = len(v)
        return self._sizes


def load(path: str) -> dict[bytes, int]:
    """A rank file: one base64 byte string and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(load(path))


def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer for a rank file, fetched once a task; ``files:NAME`` is one that was added with SparkContext.addFile."""
    release_memory()
    return _tokenizer(SparkFiles.get(path[6:]) if path.startswith("files:") else path)


def encode_slice(part: pa.RecordBatch, text_col: str, tok: Tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, text offsets in them, and the byte offset of each token in its own text."""
    data, offsets = raw_bytes(part.column(text_col))
    flat, by_text = tok.encode(data, offsets)
    ends = np.cumsum(tok.sizes[flat]) if len(flat) else np.zeros(0, np.int64)
    own = ends - tok.sizes[flat] - np.repeat(offsets[:-1], np.diff(by_text))
    return flat, by_text, own


def _encoded(path: str, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, text_col):
                flat, by_text, own = encode_slice(part, text_col, tok)
                cuts = pa.array(by_text.astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (flat, own)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *lists], names=[id_col, "ids", "offsets"])

    return run


def _decoded(path: str, columns: tuple[str, ...], ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            lists = batch.column(ids_col)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(tok.sizes[flat])])
            cuts = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
            body = b"".join(map(tok.vocabulary.__getitem__, flat.tolist()))
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in columns], texts.cast(pa.binary())], names=[*columns, "text"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows, rows.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>): token ids and the byte at which each token starts."""
    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoded(path, id_col, text_col), f"`{id_col}` {kind}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns in ``keep``, text binary): the bytes that the ids stand for; null ids count as none."""
    rows = encoded.select(id_col, *keep, *({ids_col} - set(keep)))
    schema = ", ".join(f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in (id_col, *keep))
    return rows.mapInArrow(_decoded(path, (id_col, *keep), ids_col), schema + ", text binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text binary): encoded and decoded again in one pass, one worker after the other on the same batch."""
    rows, kind = _rows(docs, id_col, text_col)
    encoded, decoded = _encoded(path, id_col, text_col), _decoded(path, (id_col, "ids"), "ids")
    return rows.mapInArrow(lambda batches: decoded(encoded(batches)), f"`{id_col}` {kind}, ids array<int>, text binary")


def span(ids: list[int], offsets: list[int], start: int, end: int, tok: Tokenizer) -> bytes:
    """Bytes ``start`` to ``end`` of a text, decoding only the tokens that overlap them."""
    first = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
    last = int(np.searchsorted(offsets, end, side="left"))
    if first >= last:
        return b""
    body = b"".join(tok.vocabulary[i] for i in ids[first:last])
    return body[max(0, start - offsets[first]) : end - offsets[first]]
