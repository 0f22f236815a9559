"""Mixing sources to target weights, by blocks of words.

The words of each source, document after document, are cut into blocks of a
fixed length. Targets decide how many block slots a source gets; a source's
slots run through pseudorandom permutations of its block numbers, one an epoch,
so that every block is taken equally often up to one. How many slots of a source
each output shard gets is a multinomial draw over the shards, so that every
source meets its quota whatever the draw; a source of many slots draws along a
binary tree of shard ranges with a seed at every node, so that its parts are
drawn side by side. Slots then meet blocks by a join on (source, block).

Sources are a table, however many there are: their order, targets and slots are
columns of it, and the driver holds sums alone.

Defined cases: a null text has no words and is never taken; very long texts are
laid out over as many blocks as they need; a null source is a source of its own,
after all others; rows that repeat an id are laid out apart, and equal rows
are interchangeable; an empty table gives no rows; other columns are passed on,
whatever their names. Results follow from the rows and the seed, not from how
they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import any_order, checkpointed, fresh, mixed, raw_bytes, text_or_empty, words

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and blocks of an output shard on average.
BLOCK_WORDS, SHARD_SLOTS = 128, 8192
#: Weights by place in the order of sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken at most so often.
MOST_EPOCHS = 3
#: Rows that a bucket of the layout has on average.
BUCKET_ROWS = 1000
#: Slots of a source that one row of the draw stands for, about.
PART_SLOTS = 1 << 17
#: Sources and bytes of their names up to which the plan is broadcast; beyond, it is dealt out by source and salt.
BROADCAST_SOURCES, BROADCAST_BYTES, SALTS = 20_000, 4 << 20, 16


@dataclass(frozen=True)
class Plan:
    """``sources``: (source, source_no, source_size, target, blocks, slots), and what the driver knows of them."""

    sources: DataFrame
    count: int
    name_bytes: int
    shards: int
    seed: int
    block_words: int


def in_order(totals: DataFrame) -> DataFrame:
    """Adds source_no, from 0 by code point, null last. Sorted in ranges side by side; counts of ranges give the rest."""
    rows = totals.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id())
    rows = checkpointed(rows).withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a task of the sort.
    before = F.broadcast(counts.select("_range", before.alias("_before")))
    return rows.join(before, "_range").withColumn("source_no", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds target: shares of the total by weight; what exceeds a source's limit is shared again among the others by weight.

    Each round is a sum over the sources that are below their limit at the share of the round before.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = sources.withColumns({"_w": w, "_most": F.col("source_size") * most})
    total, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    left, free = total, weight
    while free:
        over = F.lit(left) * F.col("_w") / F.lit(free) > F.col("_most")
        capped, open_ = rows.agg(F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))).first()
        if open_ == free or not open_:
            break
        left, free = total - capped, open_
    share = F.lit(left) * F.col("_w") / F.lit(free or 1.0)
    return rows.withColumn("target", F.when(share > F.col("_most"), F.col("_most").cast("double")).otherwise(share)).drop("_w", "_most")


def with_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds blocks and slots: whole epochs, and blocks of one more for the rest of the target."""
    size, n = F.col("source_size"), F.ceil(F.col("source_size") / block_words)
    epochs = F.least(F.floor(F.col("target") / size + 1e-9), F.lit(most))
    rest = F.least(n, F.rint((F.col("target") - epochs * size) / F.least(F.lit(block_words), size)).cast("long"))
    slots = F.when(size == 0, 0).otherwise(epochs * n + F.when(epochs < most, rest).otherwise(0))
    return sources.withColumns({"blocks": n.cast("long"), "slots": slots.cast("long")})


def plan(totals: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> Plan:
    """The plan for (source, source_size)."""
    sources = checkpointed(with_slots(with_targets(checkpointed(in_order(totals)), weights), block_words))
    n, names, slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    return Plan(sources, n, names, max(1, -(-slots // SHARD_SLOTS)), seed, block_words)


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel network on the next even power of two, walked until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(4, dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in keys:
            a, b = b, a ^ (mixed(b ^ k) & mask)
        return (a << shift) | b

    out = once(at.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def part_of(slots: int, shards: int, parts: int, part: int, seed: tuple[int, ...]) -> tuple[int, int, int, int]:
    """(first shard, end, first slot, slots) of one of ``parts`` (a power of two) ranges of shards: slots fall to the
    halves of a range by their numbers of shards."""
    first, end, before, count = 0, shards, 0, slots
    at, width = 0, parts
    while width > 1:
        width //= 2
        middle = min(max(-(-(at + width) * shards // parts), first), end)
        left = 0 if middle == first else count if middle == end else int(np.random.default_rng((*seed, at, width)).binomial(count, (middle - first) / (end - first)))
        if part < at + width:
            end, count = middle, left
        else:
            first, before, count, at = middle, before + left, count - left, at + width
    return first, end, before, count


def drawn_part(source: int, slots: int, blocks: int, shards: int, parts: int, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, block) of the slots of a source that fall to a range of shards: each slot to one of them, all alike likely,
    which makes the counts by shard multinomial."""
    first, end, before, n = part_of(slots, shards, parts, part, (seed, source))
    shard = np.sort(np.random.default_rng((seed, source, part, parts, 1)).integers(first, end, n)) if n else np.zeros(0, np.int64)
    j, block = np.arange(before, before + n), np.empty(n, np.int64)
    for epoch in range(before // blocks, (before + n - 1) // blocks + 1) if n else ():
        own = j // blocks == epoch
        block[own] = permuted(j[own] % blocks, blocks, seed * 1_000_003 + source * 4 + epoch)
    return shard, block


def slots(p: Plan) -> DataFrame:
    """(shard, place, source_no, block): the mix, slot by slot; a shard's order is that of ``place``."""
    most = 1 << (p.shards - 1).bit_length()
    parts = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("slots") / PART_SLOTS, F.lit(1))))), F.lit(most)).cast("long")
    rows = p.sources.filter("slots > 0").select("source_no", "slots", "blocks", parts.alias("parts"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # A row stands for many slots: the number of tasks is given, by the slots they make.
    tasks = max(1, min(p.shards * SHARD_SLOTS // PART_SLOTS + p.count // 4096 + 1, 100_000))
    shards, seed = p.shards, p.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = 0, []
            for row in batch.to_pylist():
                shard, block = drawn_part(row["source_no"], row["slots"], row["blocks"], shards, row["parts"], row["part"], seed)
                place = mixed(mixed(block.astype(np.uint64) + np.uint64(row["source_no"] << 40 & (2**64 - 1))) + shard.astype(np.uint64)).view(np.int64)
                out.append((shard, place, np.full(len(shard), row["source_no"]), block))
                held += len(shard)
                if held >= PART_SLOTS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["shard", "place", "source_no", "block"])
                    held, out = 0, []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["shard", "place", "source_no", "block"])

    return rows.repartition(tasks).mapInArrow(run, "shard long, place long, source_no long, block long")


def _before(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds ``before``: sums of ``value`` over smaller ``order``, in two levels so that no window holds all of a key."""
    wide = df.withColumn("_g", F.floor(F.col(order) / 1024))
    tops = wide.groupBy(by, "_g").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(by, "_g", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_top"))
    v = Window.partitionBy(by, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = wide.withColumn("_own", F.coalesce(F.sum(value).over(v), F.lit(0)))
    return own.join(tops, [by, "_g"]).withColumn("before", F.col("_own") + F.col("_top")).drop("_g", "_own", "_top")


def with_plan(rows: DataFrame, p: Plan) -> DataFrame:
    """Adds source_no, source_size and target to rows (id, h, source, ..)."""
    known = p.sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if p.count <= BROADCAST_SOURCES and p.name_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), same).drop("source", "_source")
    # A source may have a third of all rows: salts deal them out.
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id", "h"), F.lit(SALTS)).cast("int"))
    return rows.join(known.hint("merge"), same & (F.col("_own") == F.col("_salt"))).drop("source", "_source", "_own", "_salt")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, Plan]:
    """((id, h, size, source_no, source_size, target) of every row, the plan); h is a hash of text and source."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col, F.col(source_col).cast("string")).alias("h"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = checkpointed(rows)
    p = plan(rows.groupBy("source").agg(F.sum("size").alias("source_size")), seed, weights, block_words)
    return with_plan(rows, p), p


def placed(rows: DataFrame) -> DataFrame:
    """Adds bucket, rn and start: the words of its source before each row.

    Rows fall into buckets by a hash of id and text; a bucket's rows are summed in order of id, buckets in turn.
    """
    n = F.lit(max(1, -(-rows.count() // BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "h"), n))
    w = Window.partitionBy("source_no", "bucket").orderBy("id", "h")
    own = rows.withColumn("rn", F.row_number().over(w)).withColumn("_own", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    starts = _before(totals, "source_no", "bucket", "words").select("source_no", "bucket", "before")
    return own.join(starts, ["source_no", "bucket"]).withColumn("start", F.col("before") + F.col("_own")).drop("_own", "before")


def taken_pieces(rows: DataFrame, p: Plan) -> DataFrame:
    """Pieces of rows by block: the row's columns, block, at (first word within the row), words, times (how often taken).

    A row without words has one piece with a null block.
    """
    b = p.block_words
    last = F.when(F.col("size") > 0, F.floor((F.col("start") + F.col("size") - 1) / b))
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), last))))
    first, end = F.greatest(F.col("block") * b, F.col("start")), F.least((F.col("block") + 1) * b, F.col("start") + F.col("size"))
    pieces = pieces.withColumn("at", first - F.col("start")).withColumn("words", end - first)
    drawn = slots(p).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    # The planner takes the slots for as few rows as there are parts; the hint keeps it from broadcasting them.
    return pieces.join(drawn.hint("merge"), ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    rows, p = sized(docs, id_col, **options)
    pieces = taken_pieces(placed(rows), p)
    same = [F.first(c).alias(c) for c in ("size", "source_size", "target")]
    taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken")
    out = pieces.groupBy("id", "source_no", "bucket", "rn").agg(*same, taken)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def runs_of(pieces: list[dict]) -> list[tuple[int, int]]:
    """(first word, end) of the stretches to emit: for each repetition, pieces taken at least so often, joined where they touch."""
    pieces = sorted(pieces, key=lambda x: x["at"])
    out = []
    for times in range(1, max((x["times"] for x in pieces), default=0) + 1):
        start = end = None
        for x in pieces:
            if x["times"] < times:
                continue
            if end is not None and x["at"] != end:
                out.append((start, end))
                start = None
            start = x["at"] if start is None else start
            end = x["at"] + x["words"]
        if start is not None:
            out.append((start, end))
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents with the columns of the input: one row for every stretch of a document that is taken,
    as often as it is taken. A stretch of the whole document has its text unchanged. Rows that repeat id, text and
    source have the other columns of one of them."""
    rows, p = sized(docs, id_col, text_col, source_col, **options)
    pieces = taken_pieces(placed(rows), p).filter(F.col("times") > 0)
    # Pieces of a row, as many as its blocks; identical rows keep theirs apart by rn.
    own = pieces.groupBy("id", "h", "source_no", "bucket", "rn").agg(F.first("size").alias("size"), F.collect_list(F.struct("at", "words", "times")).alias("pieces"))
    names = docs.columns
    their_id, no_id, their_h, place, own_id, no_own, own_h, size, own_pieces = fresh(docs, "id_text", "no_id", "h", "place", "own_id", "no_own", "own_h", "size", "pieces")
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    texts = docs.withColumns({their_id: text_of(F.col(id_col)), no_id: F.col(id_col).isNull(), their_h: F.xxhash64(text_col, F.col(source_col).cast("string"))})
    # The join needs no other partitioning than the window's.
    first = Window.partitionBy(their_id, no_id, their_h).orderBy(any_order(docs))
    texts = texts.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    both = own.select(text_of(F.col("id")).alias(own_id), F.col("id").isNull().alias(no_own), F.col("h").alias(own_h), F.col("pieces").alias(own_pieces), F.col("size").alias(size))
    same = (F.col(their_id) == F.col(own_id)) & (F.col(no_id) == F.col(no_own)) & (F.col(their_h) == F.col(own_h))
    joined = texts.join(both.hint("merge"), same).select(*[F.col(f"`{c}`") for c in names], size, own_pieces)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_text, at = [], []
            texts, sizes, pieces = batch.column(text_col), batch.column(size), batch.column(own_pieces)
            for k in range(batch.num_rows):
                text, n = texts[k].as_py(), sizes[k].as_py()
                cut = None
                for first, end in runs_of(pieces[k].as_py()):
                    if (first, end) == (0, n):
                        out_text.append(text)
                    else:
                        if cut is None:
                            data, offsets = raw_bytes(pa.array([text]))
                            starts, ends, _ = words(data, offsets)
                            cut = data.tobytes()
                        out_text.append(cut[starts[first] : ends[end - 1]].decode())
                    at.append(k)
            columns = []
            for name in names:
                column = batch.column(name).take(pa.array(at, pa.int64()))
                if name == text_col:
                    column = pa.array(out_text, pa.string())
                elif name == chars_col:
                    column = pa.array([len(t) for t in out_text], pa.int64()).cast(column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
