import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gradloom.llm import graph, neardup
from gradloom.llm.graph import components

from .conftest import AWKWARD


def text(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return out


def multiset(words):
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def brute(texts, weight):
    """Classes by all pairs."""
    sets, label = [multiset(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both, union = sets[i] & sets[j], sets[i] | sets[j]
            if union and sum(weight(g) * n for g, n in both.items()) >= 0.8 * sum(weight(g) * n for g, n in union.items()):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {k: find(k) for k in range(len(texts))}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    texts = []
    for _ in range(40):
        base = text(r, r.randrange(40, 200))
        texts.append(base)
        for _ in range(r.randrange(0, 5)):
            texts.append(edited(r, base, r.randrange(0, 6)))
    boiler = text(r, 60)
    texts += [boiler + text(r, 80) for _ in range(20)]
    texts += [["a", "b"], ["a", "b"], ["a"], [], ["x"] * 300, ["x"] * 310, ["x"] * 900]
    r.shuffle(texts)
    return texts


def test_classes_are_those_of_all_pairs(documents, corpus):
    docs = documents([" ".join(t) for t in corpus], n="x", node="y", bucket="z")
    shares = neardup.document_shares(docs)
    seen = {}

    def weight(g):
        if g not in seen:
            _, grams, _ = neardup.elements(pa.array([" ".join(g)]))
            seen[g] = float(neardup.weights(grams[:1], shares)[0])
        return seen[g]

    got, want = classes(neardup.near_classes(docs)), brute(corpus, weight)
    wordless = [k for k, t in enumerate(corpus) if not t]
    assert all(got[k] == k for k in wordless)
    assert got == want


def test_a_mixed_bucket_loses_no_link(documents, monkeypatch):
    # Every document shares every bucket, so that only verification tells them apart.
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(3)
    groups = [text(r, 120) for _ in range(6)]
    texts = [edited(r, groups[k % 6], 1) for k in range(48)]
    labels, side = np.arange(48), np.full(48, 2)
    shares = np.zeros((neardup.SKETCH_ROWS, neardup.SKETCH_WIDTH), np.float32)
    links = neardup.block_links(labels, side, pa.array([" ".join(t) for t in texts]), shares, 0.8)
    root = list(range(48))
    for a, b in links:
        old, new = root[b], root[a]
        root = [new if x == old else x for x in root]
    assert len(links) == 42 and all((root[i] == root[j]) == (i % 6 == j % 6) for i in range(48) for j in range(48))


def test_samples_collide_as_often_as_texts_are_similar():
    r = random.Random(8)
    base = text(r, 400)
    shares = np.zeros((neardup.SKETCH_ROWS, neardup.SKETCH_WIDTH), np.float32)
    shares[:, ::3] = 0.3
    errors = []
    for edits in (5, 15, 40):
        column = pa.array([" ".join(base), " ".join(edited(r, base, edits))])
        t, grams, own = neardup.elements(column)
        _, sampled = neardup.samples(t, own, neardup.weights(grams, shares))
        exact = neardup.similarities(column[:1], column[1:], shares)[0]
        errors.append(abs((sampled[0] == sampled[1]).mean() - exact))
    # A few standard errors of the mean of SAMPLES draws.
    assert max(errors) < 3 * 0.5 / neardup.SAMPLES**0.5 and np.mean(errors) < 1.5 * 0.5 / neardup.SAMPLES**0.5


def test_samples_collide_by_weight_over_many_pairs():
    r, shares = random.Random(9), np.zeros((neardup.SKETCH_ROWS, neardup.SKETCH_WIDTH), np.float32)
    shares[:, ::3] = 0.5
    got, want = [], []
    for k in range(150):
        base = text(r, 120)
        column = pa.array([" ".join(base), " ".join(edited(r, base, 3 + k % 5))])
        t, grams, own = neardup.elements(column)
        _, sampled = neardup.samples(t, own, neardup.weights(grams, shares))
        got.append((sampled[0] == sampled[1]).mean())
        want.append(neardup.similarities(column[:1], column[1:], shares)[0])
    assert abs(np.mean(got) - np.mean(want)) < 4 * 0.5 / (150 * neardup.SAMPLES) ** 0.5


def test_similarity_is_weighted_multiset_jaccard():
    a, b = "a b c d e " * 3 + "q r s", "a b c d e " * 2 + "q r t u"
    shares = np.zeros((neardup.SKETCH_ROWS, neardup.SKETCH_WIDTH), np.float32)
    x, y = multiset(a.split()), multiset(b.split())
    want = sum((x & y).values()) / sum((x | y).values())
    assert neardup.similarities(pa.array([a]), pa.array([b]), shares)[0] == pytest.approx(want)


def test_awkward_rows(documents):
    docs = documents([*AWKWARD, "one  two three\nfour five six"], ids=[0, 1, 2, 3, 4, 5, 6, 7, None, 9], class_id="x", kept="y")
    got = neardup.near_classes(docs).collect()
    assert len(got) == 10 and {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == {**{k: k for k in range(8)}, 9: 7}
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(8))


def test_repeated_rows_and_empty_table(documents):
    docs = documents(["a b c d e f", "a b c d e f", "g h i j k l"], ids=[1, 1, 1])
    assert sorted((r["doc_id"], r["text"]) for r in neardup.keep_one_of_each(docs).collect()) == [(1, "a b c d e f"), (1, "g h i j k l")]
    assert neardup.near_classes(documents([])).count() == 0


def test_one_of_each_class_stays_whatever_the_names_and_ids(documents):
    r = random.Random(15)
    base = text(r, 200)
    near = " ".join(edited(r, base, 1))
    names = dict.fromkeys(("_id", "_own", "_node", "own_id", "no_id", "own_node", "apart", "place", "node", "id", "text_hash", "size", "bands"), "x")
    docs = documents([" ".join(base), near, "\n".join(base), " ".join(base), "", "", None, "a b c d e f", "a b c d e f"], ids=[4, 4, 4, 9, 1, 1, None, None, None], **names)
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    rows = sorted((str(x["doc_id"]), len((x["text"] or "").split()), x["_id"], x["_own"], x["_node"]) for x in kept.collect())
    assert rows == [("1", 0, "x", "x", "x"), ("1", 0, "x", "x", "x"), ("4", 200, "x", "x", "x"), ("None", 0, "x", "x", "x"), ("None", 6, "x", "x", "x")]


def test_null_ids_do_not_meet_each_other(documents):
    r = random.Random(16)
    base = [text(r, 80) for _ in range(30)]
    docs = documents([" ".join(t) for b in base for t in (b, edited(r, b, 1))], ids=[None] * 60)
    assert neardup.keep_one_of_each(docs).count() == 30


def test_long_texts_make_blocks_smaller(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    r = random.Random(17)
    base = text(r, 150)
    texts = [" ".join(edited(r, base, 6)) for _ in range(24)]
    docs = documents(texts)
    shares = neardup.document_shares(docs)
    want = {}
    for i in range(24):
        for j in range(i):
            if neardup.similarities(pa.array([texts[i]]), pa.array([texts[j]]), shares)[0] >= 0.8:
                want.setdefault(i, set()).add(j)
    got = classes(neardup.near_classes(docs))
    assert all(got[i] == got[j] for i, js in want.items() for j in js)


def test_sets_of_many_edges_are_told_apart(spark):
    # Sums of hashes over so many edges would leave the range of a long.
    edges = spark.range(20_000_000).selectExpr("id AS u", "id DIV 7 AS v")
    n, *hashes = graph._mark(edges)
    assert n == 20_000_000 and hashes != list(graph._mark(edges.withColumn("v", edges.v + 1)))[1:]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
