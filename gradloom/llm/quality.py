"""Quality rules: learned decision lists over text statistics.

Statistics come from one vectorised pass over whole texts. A decision list is
learned on the driver from a bounded sample of labelled rows by sequential
covering: each rule is a conjunction of thresholds, grown on two thirds of the
sample and pruned on the rest, and rows that it covers leave the sample before
the next rule is sought. The list becomes an ordered ``CASE WHEN`` expression,
so that applying it needs no Python.

Defined cases: a null or empty text has no words and all statistics zero, so
the base rule rejects it; very long texts are read whole, in slices of their
own; null labels and ids are left out of the sample, and of labelled rows that
repeat an id one counts, that of the smallest features; without labels of both
kinds the list is empty and keeps what passes the base rule; repeated ids are
judged apart as rows; an empty table gives no rows; other columns are ignored or
passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, raw_bytes, shingles, slices, span_hashes, sums_by_text, words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of the windows whose repeats are counted.
WINDOW = 8
#: Most labelled rows that a decision list is fitted on; they are chosen by a hash of the id.
SAMPLE_ROWS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_punct", "n_long_words", "n_distinct_words")
STATS = BASE + EXTRA

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?"]] = True
#: UTF-8 bytes that begin a character.
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _repeated_words(hashes: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Per text: words inside windows of WINDOW words that occur twice or more in it."""
    grams, offsets = shingles(hashes, word_offsets, WINDOW)
    counts = np.diff(word_offsets)
    whole = np.repeat(counts >= WINDOW, np.diff(offsets))
    text = np.repeat(np.arange(len(counts)), np.diff(offsets))[whole]
    at = (np.arange(offsets[-1]) - np.repeat(offsets[:-1] - word_offsets[:-1], np.diff(offsets)))[whole]
    grams = grams[whole]
    if not len(grams):
        return np.zeros(len(counts), np.int64)
    order = np.lexsort((grams, text))
    g, t = grams[order], text[order]
    same = np.zeros(len(g) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (t[1:] == t[:-1])
    twice = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return sums_by_text(np.cumsum(edge[:-1]) > 0, word_offsets)


def _line_counts(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them that equal an earlier line of the text."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, text))
    text, starts = text[order], starts[order]
    ends = np.append(starts[1:] - 1, 0)[: len(starts)]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    ends[last] = offsets[1:][text[last]]
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    text, starts, ends = text[worded], starts[worded], ends[worded]
    lines = np.bincount(text, minlength=n)
    h = span_hashes(data, starts, ends)
    order = np.lexsort((h, text))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return lines, np.bincount(text[order][same], minlength=n)


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of a column of texts."""
    data, offsets = raw_bytes(column)
    n = len(offsets) - 1
    starts, ends, word_offsets = words(data, offsets)
    counts = np.diff(word_offsets)
    hashes = span_hashes(data, starts, ends)
    by = lambda mask: sums_by_text(mask[data], offsets)
    text = np.repeat(np.arange(n), counts)
    order = np.lexsort((hashes, text))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    lines, dup_lines = _line_counts(data, offsets, starts)
    return {
        "n_words": counts,
        "word_chars": by(_LEAD & ~_IS_SPACE),
        "n_symbols": by(_SYMBOL),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeated_words(hashes, word_offsets),
        "n_lines": lines,
        "n_upper": by(_UPPER),
        "n_digits": by(_DIGIT),
        "n_punct": by(_PUNCT),
        "n_long_words": sums_by_text((ends - starts) > 12, word_offsets),
        "n_distinct_words": np.bincount(text[order][new], minlength=n),
    }


def _stats_batches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                stats = text_stats(part.column(text_col))
                rest = [(f, c) for f, c in zip(part.schema.names, part.columns, strict=True) if f != text_col]
                columns = [c for _, c in rest] + [pa.array(stats[k].astype(np.int64)) for k in STATS]
                yield pa.RecordBatch.from_arrays(columns, names=[f for f, _ in rest] + list(STATS))

    return run


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns in ``keep``, statistics) of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_stats_batches("text"), ", ".join(fields + [f"{k} long" for k in STATS]))


#: What rules test: shares of the statistics, as native expressions and as numpy.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "punct_per_word": ("n_punct", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "long_word_share": ("n_long_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    """A feature as a native expression; zero where its denominator is zero."""
    top, bottom = FEATURES[name]
    return F.when(F.col(bottom) == 0, F.lit(0.0)).otherwise(F.col(top).cast("double") / F.col(bottom))


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value, or feature < value."""

    name: str
    at_least: bool
    value: float

    def column(self) -> Column:
        x = feature(self.name)
        return x >= F.lit(self.value) if self.at_least else x < F.lit(self.value)

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.name]
        return x >= self.value if self.at_least else x < self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds that rejects what it covers."""

    tests: tuple[Test, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for t in self.tests:
            out &= t.rows(table)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Test] | None:
    p0, n0 = float(bad[inside].sum()), float((~bad[inside]).sum())
    best: tuple[float, Test] | None = None
    for name in table:
        x, y = table[name][inside], bad[inside]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cut = np.flatnonzero(x[1:] != x[:-1]) + 1
        if not len(cut):
            continue
        below_p = np.cumsum(y)[cut - 1].astype(float)
        below_n = cut - below_p
        value = (x[cut] + x[cut - 1]) / 2
        for at_least, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gains = _gain(p, n, p0, n0)
            k = int(np.argmax(gains))
            if gains[k] > 1e-9 and (best is None or gains[k] > best[0]):
                best = float(gains[k]), Test(name, at_least, float(value[k]))
    return best


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    inside, tests = np.ones(len(bad), bool), []
    while len(tests) < most_tests and (~bad[inside]).any() and bad[inside].any():
        found = _best_test(table, bad, inside)
        if found is None:
            break
        tests.append(found[1])
        inside &= found[1].rows(table)
    return Rule(tuple(tests))


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = rule.rows(table)
    p, n = bad[covered].sum(), (~bad[covered]).sum()
    return float(p - n) / max(1.0, float(p + n))


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule that does best on rows it wasn't grown on."""
    options = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    return max(options, key=lambda r: (_worth(r, table, bad), -len(r.tests)))


def learn(table: dict[str, np.ndarray], good: np.ndarray, most_rules: int = 24, most_tests: int = 4, least_precision: float = 0.9, least_rows: int = 5) -> list[Rule]:
    """Sequential covering of the bad rows; stops when a pruned rule isn't precise on held-out rows."""
    bad = ~np.asarray(good, bool)
    if not bad.any() or bad.all():
        return []
    fold = np.arange(len(bad)) % 3 == 2
    rest, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and bad[rest].sum() >= least_rows:
        grow, prune = rest & ~fold, rest & fold
        if not bad[grow].any() or not bad[prune].any():
            break
        pick = lambda mask: {k: v[mask] for k, v in table.items()}
        rule = _grow(pick(grow), bad[grow], most_tests)
        if not rule.tests:
            break
        rule = _prune(rule, pick(prune), bad[prune])
        covered = rule.rows(table) & rest
        held = covered & fold
        p, n = bad[held].sum(), (~bad[held]).sum()
        if covered.sum() < least_rows or p < least_precision * (p + n) or not p:
            break
        rules.append(rule)
        rest &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered CASE WHEN: the first rule that covers a row rejects it."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label, text) of about ``most`` labelled documents at most, chosen by a hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    parts = 1 << 62
    share = int(min(1.0, most / max(known.count(), 1)) * parts)
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit(41)), F.lit(parts)) < F.lit(share))
    # `most` bounds the picked rows, so they may be broadcast.
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_ROWS) -> list[Rule]:
    """A decision list from the labelled sample. Rows that the base rule rejects anyway aren't learned from."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, most)
    stats = with_stats(sample, "id", "text", keep=("label",)).filter(~base_failed())
    # One row a labelled id, however often it stands in the table: `most` bounds what comes to the driver.
    table = stats.groupBy("id").agg(F.min(F.struct("label", *[feature(k).alias(k) for k in FEATURES])).alias("row")).select("id", "row.*").toPandas()
    table = table.sort_values(["id", *FEATURES], kind="stable")
    return learn({k: table[k].to_numpy() for k in FEATURES}, table["label"].to_numpy() > 0)


def quality(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base statistics, base_failed, kept."""
    stats = with_stats(docs, id_col, text_col)
    return stats.select(
        F.col("id").alias(id_col),
        *BASE,
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that pass base rule and list, with all their columns, judged where they lie."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + [f"{k} long" for k in STATS]
    judged = rows.mapInArrow(_stats_batches("text"), ", ".join(fields)).filter(~base_failed() & verdict(rules))
    return judged.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(names)])
