import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gradloom.llm import bpe, queries

from .test_neardup import multiset

DATA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean prose, junk, exact and near copies, in two sources."""
    folder, r = str(tmp_path_factory.mktemp("sf")), random.Random(4)
    rows, labels = [], []

    def add(text, good, source="a"):
        k = len(rows)
        rows.append((k, text, "en", source, None if text is None else len(text)))
        labels.append((k, int(good), 0))

    def prose():
        return " ".join(f"word{r.randrange(3000)}" for _ in range(r.randrange(60, 140))) + "."

    for k in range(150):
        add(prose(), True, "ab"[k % 2])
    for _ in range(60):
        add(" ".join(f"word{r.randrange(3000)}###" for _ in range(80)), False)
    for k in range(20):
        text = rows[k][1]
        add(text.replace(" ", "\n", 3), True)
        add(text.replace(text.split()[10], "changed", 1), True, "b")
    add("too short", True)
    add(None, True)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    folder, _ = corpus
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "mix_sources", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns(stages):
    assert all(s.columns == DATA_COLUMNS for s in stages[:-1])


def test_quality_keeps_clean_and_drops_junk(stages, corpus):
    kept = {r["doc_id"] for r in stages[0].collect()}
    assert kept == {r[0] for r in corpus[1] if r[1] and "###" not in r[1] and len(words(r[1])) >= 20}


def test_exact_copies_go(stages):
    before, after = stages[0].collect(), stages[1].collect()
    key = lambda r: "".join(words(r["text"]))
    assert {key(r) for r in before} == {key(r) for r in after} and len(after) == len({key(r) for r in after})


def test_near_copies_go(stages):
    before, after = stages[1].collect(), stages[2].collect()
    sets = {r["doc_id"]: multiset(words(r["text"])) for r in before}
    like = lambda a, b: sum((sets[a] & sets[b]).values()) / sum((sets[a] | sets[b]).values())
    kept = {r["doc_id"] for r in after}
    assert all(like(a, b) < 0.82 for a in kept for b in kept if a < b)
    assert all(any(like(a, b) >= 0.78 for b in kept) for a in sets if a not in kept)


def test_mix_takes_words_of_the_documents(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    rows = stages[3].collect()
    assert all(r["text"] in texts[r["doc_id"]] and len(r["text"]) == r["n_chars"] for r in rows)
    total, taken = sum(len(words(t)) for t in texts.values()), sum(len(words(r["text"])) for r in rows)
    assert abs(total - taken) < 0.05 * total


def test_ids_are_the_library_s(stages):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(public_tokenizers.path(queries.RANKS)), special_tokens={})
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, enc.encode_ordinary(r["text"]))).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in stages[3].collect())
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in stages[4].collect()) == want


def test_run_gives_the_same(spark, corpus, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus[0]).collect())) == sorted(map(tuple, stages[4].collect()))


def write(spark, folder, rows, more=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} string" for n in more)
    spark.createDataFrame([(*r, *("x" for _ in more)) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    r = random.Random(7)
    text = lambda n: " ".join(f"word{r.randrange(5000)}" for _ in range(n)) + "."
    one, two, long = text(80), text(90), text(20_000)
    near = one.replace(one.split()[40], "changed", 1)
    rows = [(3, one), (3, one), (3, one.replace(" ", "\n")), (5, near), (None, two), (None, two), (None, text(70)), (8, None), (9, ""), (10, long), (None, None)]
    rows = [(i, t, None, None if k % 2 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    more = ("_id", "_own", "digest", "node", "size", "place", "h", "key", "cells")
    write(spark, tmp_path, rows, more)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        path = f"{tmp_path}/stage{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [*DATA_COLUMNS, *more]
        if k == 2:
            assert sorted((str(x["doc_id"]), len(words(x["text"]))) for x in docs.collect()) == [("10", 20_000), ("3", 80), ("None", 70), ("None", 90)]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
