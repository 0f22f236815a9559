from __future__ import annotations

import pytest

from gradloom.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.fixture
def documents(spark):
    """A maker of document tables; ``more`` adds columns, such as ones whose names clash."""

    def make(texts, sources=None, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        schema = SCHEMA + "".join(f", {k} string" for k in more)
        rows = [(i, t, "en", s, None if t is None else len(t), *more.values()) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, schema)

    return make


#: Texts that every operator must take.
AWKWARD = ["", None, " \t\n", "a", "é 日本 🙂\x00", "word " * 3000, "x" * 50_000, "one two three four five six", "one two three four five six"]
