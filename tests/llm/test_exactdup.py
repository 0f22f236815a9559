import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradloom.llm import exactdup

from .conftest import AWKWARD


def plain(texts):
    return re.sub(r"[\x20\x09-\x0D]", "", texts or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    return sorted(((i, min(groups[plain(t)])[2], len(groups[plain(t)]), (-len(t or ""), i is None, i) == min(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows), key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def test_awkward_rows(documents):
    texts = [*AWKWARD, "one two three", "onetwothreefourfivesix"]
    docs = documents(texts, kept="x", digest="y", n="z")
    assert got(exactdup.exact_dedup(docs)) == brute(list(enumerate(texts)))


def test_heavy_digests_take_the_other_road(documents):
    texts = ["hot  text", "hot text", "hottext"] * 40 + [f"t{k % 30}" for k in range(60)]
    docs = documents(texts).repartition(5)
    rows = exactdup.checkpointed(exactdup.digests(docs))
    assert exactdup._heavy(rows, 4).count() == 1
    assert got(exactdup.exact_dedup(docs, counters=4)) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(documents):
    texts, ids = ["a", "a", "a", "b"], [None, 5, 5, None]
    out = got(exactdup.exact_dedup(documents(texts, ids=ids)))
    assert [(r[0], r[1], r[3]) for r in out] == [(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True)]


def test_kept_rows(documents):
    docs = documents(["a b", "ab ", "ab", "c", "c"], ids=[3, 2, 1, 4, 4], digest="x", _kept_id="y")
    kept = exactdup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "ab "), (4, "c")]


def test_names_may_clash_with_any_inner_one(documents):
    names = dict.fromkeys(("_id", "_own", "_sha", "digest", "code_points", "hot", "winner", "place", "w", "DIGEST_"), "x")
    kept = exactdup.keep_first_copies(documents(["a b", "ab", None, ""], **names))
    assert kept.columns[5:] == list(names)
    assert sorted((r["doc_id"], r["_id"], r["_own"]) for r in kept.collect()) == [(0, "x", "x"), (2, "x", "x")]


def test_of_rows_that_share_an_id_the_longest_stays(documents):
    # Four rows with one id, in both orders, whether their digest is frequent or not.
    for texts in (["abcd", " a b c d", "ab cd", "a b c d "], ["a b c d ", "ab cd", " a b c d", "abcd"]):
        for counters in (1, 512):
            kept = exactdup.keep_first_copies(documents(texts, ids=[7] * 4).repartition(3), counters=counters).collect()
            assert [(r["doc_id"], r["text"]) for r in kept] == [(7, " a b c d")]
    kept = exactdup.keep_first_copies(documents(["a", "a", "a", "b"], ids=[None, None, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("3", "a"), ("None", "b")]


def test_kept_rows_of_frequent_and_awkward_texts(documents):
    texts = ["hot  text", "hot text", "hottext"] * 40 + [f"t{k % 30}" for k in range(60)] + AWKWARD
    kept = exactdup.keep_first_copies(documents(texts).repartition(5), counters=4).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r[1] for r in brute(list(enumerate(texts)))})


def test_empty_table(documents):
    assert exactdup.exact_dedup(documents([])).count() == 0
    assert exactdup.keep_first_copies(documents([])).count() == 0


@given(st.lists(st.lists(st.integers(0, 12), max_size=40), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_misra_gries_keeps_what_is_frequent(parts, counters):
    summary = {}
    for p in parts:
        if p:
            summary = exactdup.merged(summary, exactdup.misra_gries(np.array(p), counters), counters)
    total, counts = sum(map(len, parts)), Counter(x for p in parts for x in p)
    assert len(summary) <= counters
    for x, n in counts.items():
        assert n - total / (counters + 1) <= summary.get(x, 0) <= n
