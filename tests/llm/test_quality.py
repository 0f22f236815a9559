import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradloom.llm import quality

from .conftest import AWKWARD


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "n_lines": lines,
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_punct": len(re.findall("[.,;:!?]", text)),
        "n_long_words": sum(len(w.encode()) > 12 for w in words),
        "n_distinct_words": len(set(words)),
    }


TEXT = st.lists(st.sampled_from(["a", "b ", "\n", " ", "c\n", "#", "É1", "a b c d e f g h i ", "x\ty", "\x0b", "A.\n"]), max_size=40).map("".join)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_statistics(texts):
    got = quality.text_stats(pa.array(texts, pa.string()))
    want = [brute(t) for t in texts]
    for k in quality.STATS:
        assert got[k].tolist() == [w[k] for w in want], k


def test_awkward_rows(documents):
    docs = documents(AWKWARD, n_words="x", kept="y", word_chars="z")
    rows = quality.quality(docs, []).orderBy("doc_id").collect()
    for r, t in zip(rows, AWKWARD, strict=True):
        want = brute(t)
        assert {k: r[k] for k in quality.BASE} == {k: want[k] for k in quality.BASE}
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]) and r["kept"] == (not r["base_failed"])
    kept = quality.keep_good(docs, [])
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def sample(n=600, seed=0):
    r = np.random.default_rng(seed)
    table = {"a": r.random(n), "b": r.random(n), "c": r.random(n)}
    bad = ((table["a"] > 0.7) & (table["b"] < 0.5)) | (table["c"] > 0.9)
    return table, ~bad


def test_covering_finds_planted_rules():
    rules = quality.learn(*sample())
    table, good = sample(seed=9)
    rejected = np.zeros(len(good), bool)
    for rule in rules:
        rejected |= rule.rows(table)
    assert (rejected == ~good).mean() > 0.97
    assert all(1 <= len(r.tests) <= 4 for r in rules)


@pytest.mark.parametrize("good", [np.ones(50, bool), np.zeros(50, bool)])
def test_one_kind_of_label_teaches_nothing(good):
    assert quality.learn({"a": np.arange(50.0)}, good) == []


def test_noise_is_pruned_away():
    r = np.random.default_rng(4)
    assert quality.learn({"a": r.random(400)}, r.random(400) > 0.5) == []


def test_list_is_an_ordered_expression():
    rules = [quality.Rule((quality.Test("symbol_share", True, 0.5),)), quality.Rule((quality.Test("upper_share", False, 0.1), quality.Test("digit_share", True, 0.2)))]
    text = str(quality.verdict(rules))
    assert text.index("n_symbols") < text.index("n_upper") and "CASE WHEN" in text
    assert str(rules[1]) == "upper_share < 0.1 and digit_share >= 0.2"


def test_held_out_accuracy(documents, spark):
    r = np.random.default_rng(2)
    words = [f"word{k}" for k in range(400)]

    def text(good):
        out = [words[k] + (" " if good else "### ") for k in r.integers(0, 400, 60)]
        return "".join(out)

    good = r.random(300) > 0.4
    docs = documents([text(g) for g in good])
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good[:200].tolist())] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    kept = {x["doc_id"]: x["kept"] for x in quality.quality(docs, rules).collect()}
    assert np.mean([kept[k] == bool(g) for k, g in enumerate(good) if k >= 200]) > 0.95


def test_empty_tables(documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(documents([]), labels) == []
    assert quality.quality(documents([]), []).count() == 0 and quality.keep_good(documents([]), []).count() == 0


def test_a_labelled_id_counts_once_however_often_it_stands(spark, documents):
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]
    docs = documents([*texts, *[texts[0]] * 500], ids=[*range(30), *[0] * 500])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    seen = {}

    def learn(table, good):
        seen["rows"] = len(good)
        return []

    original, quality.learn = quality.learn, learn
    try:
        quality.fit(docs, labels)
    finally:
        quality.learn = original
    assert seen["rows"] == 30
