"""Token counts of a SentencePiece BPE model with a whole-token shortcut.

From the vocabulary alone, before any text is read, two things are proved:

* where texts may be cut. If no piece has a space after another character, no
  merge crosses the start of a run of spaces; an ASCII character that is in no
  piece never merges at all. Cutting there gives pre-tokens that encode
  independently of each other.
* which vocabulary strings encode alone as one token: those that their own
  merges rebuild whole. Merges that can't be reached this way exist and are left out.

Pre-tokens among those strings count as one by look-up. Only the rest are
merged, once per distinct pre-token and worker; a character outside the
vocabulary counts its UTF-8 bytes.

A model that normalises texts, adds no leading space, isn't BPE or has pieces
defined by users is refused: its counts would follow other rules.

Defined cases: null and empty texts have no tokens; null ids and repeated rows
pass through; very long texts are counted whole, in slices of their own; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, distinct, raw_bytes, slices, sums_by_text
from .merging import merge

#: Distinct pre-tokens in each of the two generations that a worker remembers, beside the whole tokens.
CACHE = 300_000
#: The model's mark for a space.
MARK = "▁"


class Counter:
    """Counts for pre-tokens, given as bytes with plain spaces."""

    def __init__(self, scores: dict[str, float]):
        self.ranks = {piece: -score for piece, score in scores.items()}
        self.cuts_at_spaces = not any(a != MARK and b == MARK for piece in scores for a, b in zip(piece, piece[1:]))  # noqa: B905
        used = {c for piece in scores for c in piece}
        self.loose = np.zeros(256, bool)
        self.loose[[i for i in range(128) if chr(i) not in used and chr(i) != " "]] = True
        self.whole = {piece.replace(MARK, " ").encode(): 1 for piece in scores if len(merge(list(piece), self.ranks)) == 1}
        self.memory = Memory(CACHE)

    def count(self, pre_token: bytes) -> int:
        if (n := self.whole.get(pre_token) or self.memory.get(pre_token)) is None:
            parts = merge(list(pre_token.decode().replace(" ", MARK)), self.ranks)
            n = sum(1 if p in self.ranks else len(p.encode()) for p in parts)
            if len(pre_token) <= 256:
                self.memory.put(pre_token, n)
        return n

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        data, offsets = _prefixed(*_plain(data, offsets))
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        space, loose = data == 32, self.loose[data]
        first = loose.copy()
        first[1:] |= loose[:-1]
        if self.cuts_at_spaces:
            first[1:] |= space[1:] & ~space[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        pieces, place = distinct(data, starts, np.array([len(data)]))
        found = np.fromiter(map(self.count, pieces), np.int64, len(pieces))
        return sums_by_text(found[place], np.searchsorted(starts, offsets))


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mark inside a text means a space, too."""
    body = data.tobytes()
    if MARK.encode() not in body:
        return data, offsets
    texts = [body[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]  # noqa: B905
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space in front of each text that isn't empty."""
    full = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    return np.insert(data, offsets[:-1][full], np.uint8(32)), moved


def _fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(body):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, body[at : at + size]
        at += size


def refuse_others(model: bytes) -> None:
    """Raise on a model that this module can't count for. Numbers are those of the format's published fields."""
    pieces = [dict(_fields(v)) for k, v in _fields(model) if k == 1]
    trainer, normaliser = ({k: v for n, m in _fields(model) if n == part for k, v in _fields(m)} for part in (2, 3))
    faults = {
        "it isn't a BPE model": trainer.get(3, 1) != 2,
        "it marks spaces behind words": trainer.get(24, 0),
        "it maps characters": normaliser.get(2),
        "it adds no leading space": not normaliser.get(3, 1),
        "it removes spaces": normaliser.get(4, 1),
        "it leaves spaces unmarked": not normaliser.get(5, 1),
        "it has pieces defined by users": any(p.get(3, 1) == 4 for p in pieces),
    }
    if found := [text for text, fault in faults.items() if fault]:
        raise ValueError("this model can't be counted for: " + ", ".join(found))


@lru_cache(2)
def counter(path: str) -> Counter:
    """A counter for a BPE .model file whose normalisation leaves texts as they are."""
    import sentencepiece

    with open(path, "rb") as f:
        refuse_others(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return Counter({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            for part in slices(batch):
                data, offsets = raw_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(offsets)), pa.array(known.counts(data, offsets))], names=[id_col, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
