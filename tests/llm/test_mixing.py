import re

import numpy as np
import pytest

from gradloom.llm import mixing

from .conftest import AWKWARD


def words(text):
    return re.findall(mixing.WORD, text or "")


def targets(sizes, weights=mixing.WEIGHTS, most=3):
    """By the rule, one source after the other."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[k] for k in free)
        over = [k for k in free if left * w[k] / total > most * sizes[k]]
        for k in over or free:
            out[k] = float(most * sizes[k]) if over else left * w[k] / total
        left -= sum(out[k] for k in over)
        free = free - set(over) if over else set()
    return out


def totals(spark, sizes):
    return spark.createDataFrame([(None if k is None else k, n) for k, n in sizes], "source string, source_size long")


@pytest.mark.parametrize("seed", range(2))
def test_targets(spark, seed):
    r = np.random.default_rng(seed)
    names = [None, *(f"s{k}" for k in range(30))]
    sizes = [(x, int(n)) for x, n in zip(names, np.where(r.random(31) < 0.2, 0, r.lognormal(5, 3, 31)), strict=True)]
    rows = mixing.with_targets(mixing.in_order(totals(spark, sizes))).orderBy("source_no").collect()
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    assert [(x["source"], x["source_size"], x["source_no"]) for x in rows] == [(*x, k) for k, x in enumerate(order)]
    assert [x["target"] for x in rows] == pytest.approx(targets([n for _, n in order]))


def test_no_targets_of_nothing(spark):
    assert mixing.with_targets(mixing.in_order(totals(spark, []))).count() == 0
    assert [r["target"] for r in mixing.with_targets(mixing.in_order(totals(spark, [("a", 0), (None, 0)]))).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 70_001])
def test_permutations(n):
    out = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert out.tolist() != mixing.permuted(np.arange(n), n, 12346).tolist() and abs(np.corrcoef(out, np.arange(n))[0, 1]) < 0.3


@pytest.mark.parametrize("parts", [1, 2, 16])
def test_parts_draw_every_slot_once(parts):
    slots, blocks, shards = 50_000, 20_000, 13
    found = [mixing.drawn_part(7, slots, blocks, shards, parts, k, 3) for k in range(parts)]
    shard, block = (np.concatenate(x) for x in zip(*found, strict=True))
    assert len(shard) == slots and (np.diff(shard) >= 0).all() and 0 <= shard.min() and shard.max() < shards
    times = np.bincount(block, minlength=blocks)
    assert (times.min(), times.max()) == (2, 3)
    counts = np.bincount(shard, minlength=shards)
    # Multinomial: chi-squared of 12 degrees of freedom.
    assert 2 < ((counts - slots / shards) ** 2 / (slots / shards)).sum() < 40


def test_ranges_of_shards_share_all_slots_whatever_their_number():
    for slots, shards, parts in ((3_000_000_000_001, 10**8, 1 << 14), (5, 3, 8), (0, 7, 4)):
        at = [mixing.part_of(slots, shards, parts, k, (1, 2)) for k in sorted({0, 1, 2, parts // 3 % parts, parts - 1})]
        assert at[0][:1] == (0,) and at[-1][1] == shards and at[0][2] == 0 and at[-1][2] + at[-1][3] == slots
        if parts > 8:
            assert all(abs(n - slots / parts) < 20 * (slots / parts) ** 0.5 and abs(b - a - shards / parts) <= 1 for a, b, _, n in at)
    every = [mixing.part_of(1000, 5, 8, k, (4, 4)) for k in range(8)]
    assert sum(n for *_, n in every) == 1000 and all(x[2] + x[3] == y[2] and x[1] == y[0] for x, y in zip(every, every[1:]))  # noqa: B905


def test_slots_of_a_plan(spark):
    p = mixing.plan(totals(spark, [("a", 900_000), ("b", 500_000), (None, 40_000), ("c", 0)]), seed=3, block_words=4)
    rows = mixing.slots(p).toPandas()
    want = {r["source_no"]: r for r in p.sources.collect()}
    assert rows.groupby("source_no").size().to_dict() == {k: r["slots"] for k, r in want.items() if r["slots"]}
    for k, own in rows.groupby("source_no"):
        times = np.bincount(own["block"], minlength=want[k]["blocks"])
        assert len(times) == want[k]["blocks"] and (times.min(), times.max()) == (want[k]["slots"] // len(times), -(-want[k]["slots"] // len(times)))
    assert rows["shard"].max() < p.shards and rows.groupby("shard").size().between(0.9 * 8192, 1.1 * 8192).all()


def test_many_sources(documents, spark):
    n = 200_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w ', repeat('x ', CAST(id % 3 AS INT))) AS text", "'en' AS lang", "concat('host', id) AS source", "1L AS n_chars")
    got = mixing.mix(docs).selectExpr("count(*)", "sum(size)", "sum(taken)", "max(taken / size)", "sum(target)").first()
    assert got[0] == n and got[1] == sum(k % 3 + 1 for k in range(n)) and got[3] <= 3
    assert got[4] == pytest.approx(got[1]) and abs(got[2] - got[1]) < 0.05 * got[1]


def corpus(documents):
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 50, int(n))) for n in r.lognormal(4.5, 1, 400)]
    sources = [["a", "b", "c", "d", None][k] for k in r.integers(0, 5, 400)]
    return documents(texts, sources), texts, sources


def test_mix_comes_near_its_targets(documents):
    docs, texts, sources = corpus(documents)
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(rows) == len(texts)
    sizes = {s: sum(len(words(t)) for t, o in zip(texts, sources, strict=True) if o == s) for s in set(sources)}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([sizes[s] for s in order]), strict=True))
    for s in order:
        own = [rows[k] for k, o in enumerate(sources) if o == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and [r["target"] for r in own] == pytest.approx([goal[s]] * len(own))
        # Half a block of rounding, and a last block that may be short.
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= 1.5 * mixing.BLOCK_WORDS
    assert all(r["taken"] <= 3 * r["size"] and r["size"] == len(words(texts[k])) for k, r in rows.items())


def test_reruns_agree_however_rows_lie_and_the_plan_travels(documents, spark, monkeypatch):
    docs, texts, _ = corpus(documents)
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    # The second run deals the plan out by salts.
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    two = sorted(map(tuple, mixing.mix(docs.repartition(5, "text")).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = dict.fromkeys(range(len(texts)), 0)
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert got == {r[0]: r[4] for r in one}


def test_awkward_rows(documents):
    sources, ids = ["b", None, "a", None, "b", "a", "b", "a", "a"], [0, 1, 2, None, 4, 5, 6, 7, 7]
    clash = dict.fromkeys(("size", "taken", "h", "id", "pieces", "place", "own_id", "no_id", "ID_TEXT", "target", "source_no"), "x")
    docs = documents(AWKWARD, sources=sources, ids=ids, **clash)
    rows = mixing.mix(docs).collect()
    sizes = [len(words(t)) for t in AWKWARD]
    by_source = {s: sum(n for n, o in zip(sizes, sources, strict=True) if o == s) for s in ("a", "b", None)}
    goal = dict(zip(by_source, targets(list(by_source.values())), strict=True))
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in rows) == sorted((str(i), n, by_source[s]) for i, n, s in zip(ids, sizes, sources, strict=True))
    of = dict(zip(ids, sources, strict=True))
    assert all(r["target"] == pytest.approx(goal[of[r["doc_id"]]]) and r["taken"] <= 3 * r["size"] for r in rows)
    for s in by_source:
        assert abs(sum(r["taken"] for r in rows if of[r["doc_id"]] == s) - goal[s]) <= 1.5 * mixing.BLOCK_WORDS
    out = mixing.mixed_documents(docs)
    got = out.collect()
    assert out.columns == docs.columns and sum(len(words(r["text"])) for r in got) == sum(r["taken"] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) and r["pieces"] == "x" for r in got)


def test_rows_with_null_ids_and_equal_rows(documents):
    texts = [f"n{k} " * 40 for k in range(30)] + ["same text here " * 20] * 30
    docs = documents(texts, ids=[None] * 30 + [5] * 30)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 60 and sum(r["taken"] for r in rows) == sum(r["size"] for r in rows) == 30 * 40 + 30 * 60
    assert sum(len(words(r["text"])) for r in mixing.mixed_documents(docs).collect()) == 30 * 40 + 30 * 60


def test_empty_table(documents):
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).count() == 0
    assert mixing.mix(documents(["", None])).agg({"taken": "sum"}).first()[0] == 0
