"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. One pass makes a digest per row. Misra-Gries
summaries of the digests, one a task, name every digest that may hold more than
2/(counters+1) of the rows; an exact count of just those confirms them, and
their winners (at most ``counters`` rows) are broadcast so that hot rows are
settled where they lie. All other digests are grouped and joined by an ordinary
shuffle, in which no key is hot.

Defined cases: a null text counts as empty, and all empty or all-white texts
are one group; very long texts are digested whole; a null id sorts after every
other id when rows tie, and rows that share id and text length all carry the
same ``keep_id`` while exactly the rows with that id are kept (of which
``keep_first_copies`` lets one through); an empty table gives no rows; columns of
the input other than id and text are ignored or passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, any_order, checkpointed, fresh, text_or_empty

#: Counters of a Misra-Gries summary; also the most rows that are broadcast.
COUNTERS = 512


def normalised(text):
    """The text without white space, as a native expression."""
    return F.translate(text, SPACE, "")


def misra_gries(values: np.ndarray, counters: int) -> dict:
    """Misra-Gries over a block of values: each value with more than len/(counters+1) rows is in the result.

    Counts the whole block at once and then subtracts the (counters+1)-th largest
    count from all, which is what the sequential decrements amount to.
    """
    kinds, counts = np.unique(values, return_counts=True)
    return _cut(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), counters)


def _cut(summary: dict, counters: int) -> dict:
    if len(summary) <= counters:
        return summary
    least = sorted(summary.values(), reverse=True)[counters]
    return {k: v - least for k, v in summary.items() if v > least}


def merged(a: dict, b: dict, counters: int) -> dict:
    """Two summaries as one, with the same guarantee over both inputs."""
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + v
    return _cut(out, counters)


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict = {}
        for batch in batches:
            if batch.num_rows:
                summary = merged(summary, misra_gries(batch.column(0).to_numpy(zero_copy_only=False).astype(str), counters), counters)
        # A value that a task saw once is as frequent as any other there; exact counts decide later.
        yield pa.RecordBatch.from_pydict({"digest": list(summary), "n": list(summary.values())}, schema=pa.schema([("digest", pa.string()), ("n", pa.int64())]))

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest): code points of the original text and SHA-256 of the normalised one."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.length(text).cast("long").alias("n"),
        F.sha2(normalised(text).cast("binary"), 256).alias("digest"),
    )


def _winner():
    """Most code points, then the smallest id, nulls last."""
    return F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("id").isNull().alias("no_id"), F.col("id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(digests(docs, id_col, text_col))
    heavy = _heavy(rows, counters)
    # At most `counters` rows: a proven bound.
    known = F.broadcast(heavy)
    grouped = lambda df: df.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("w"))
    hot = rows.join(known, "digest")
    cold = rows.join(known, "digest", "left_anti")
    rest = cold.join(grouped(cold), "digest")
    return hot.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("w.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("id").eqNullSafe(F.col("w.id"))) & (F.col("n") == -F.col("w.minus_n"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _heavy(rows: DataFrame, counters: int) -> DataFrame:
    """Digests of more than 1/(counters+1) of the rows with their exact size and winner."""
    total = rows.count()
    candidates = (
        rows.select("digest")
        .mapInArrow(_summaries(counters), "digest string, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        # The summed lower bounds miss at most total/(counters+1) rows of a digest, so every digest
        # of more than twice that is among the largest `counters`.
        .orderBy(F.desc("n"), "digest")
        .limit(counters)
        .select("digest")
    )
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("w"))
    return checkpointed(exact.filter(F.col("group_size") * (counters + 1) > F.lit(total)))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns: most code points, then the
    smallest id (null last), then the smallest text, then any order that is the same on every run.

    Rows of frequent digests that can't win go where they lie; of the others the first of each digest in a task travels on.
    """
    heavy = _heavy(checkpointed(digests(docs, id_col, text_col)), counters)
    own, n, hot, w, place = fresh(docs, "digest", "code_points", "hot", "winner", "place")
    text = text_or_empty(text_col)
    rows = docs.withColumns({own: F.sha2(normalised(text).cast("binary"), 256), n: F.length(text).cast("long")})
    # At most `counters` rows: a proven bound.
    known = F.broadcast(heavy.select(F.col("digest").alias(hot), F.col("w").alias(w)))
    wins = F.col(id_col).eqNullSafe(F.col(f"{w}.id")) & (F.col(n) == -F.col(f"{w}.minus_n"))
    rows = rows.join(known, F.col(own) == F.col(hot), "left").filter(F.col(hot).isNull() | wins).drop(hot, w)
    first = Window.partitionBy(own).orderBy(F.desc(n), F.asc_nulls_last(id_col), text_col, any_order(docs))
    return rows.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(own, n, place)
