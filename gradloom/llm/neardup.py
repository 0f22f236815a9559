"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles. The j-th occurrence of a
shingle in a document is an element of its own, so that term frequency is the
number of elements and every element weighs the shingle's IDF. IDF follows the
share f of documents with the shingle, ``ln(1 + 1 / (f + SMOOTH))``, scaled so
that rare shingles weigh 1; shares come from a count-min sketch of fixed size
over all documents, corrected for its mean collisions, and shares below its
resolution count as rare.

1. Every document gets SAMPLES improved consistent weighted samples. The three
   random variables of an (element, sample) pair come from a pool of 65536
   precomputed triples, chosen by a hash; ties are broken by the element's
   hash, which keeps samples consistent. BANDS bands of ROWS samples are keys.
2. Documents of equal word sequences are one node; the smallest node of each
   band bucket is compared with the bucket's other nodes (a star, linear in the
   bucket). Weighted Jaccard similarity on whole texts decides.
3. Components are formed. In buckets that still hold several components, all
   nodes are compared across components, in blocks of bounded size whose
   similarities are matrix products. So no pair that shares a bucket is lost,
   while a large group of near copies costs a star and not its square.
4. Components again.

Samples are of elements alone: the quantised weight that consistent sampling
gives beside them (its second part) is left out, as it decides next to nothing.

Defined cases: null and wordless texts have no shingle and are classes of their
own, as is a document under five words that shares its one shingle with no
other; very long texts are sampled and compared whole, in slices and blocks of
their own; ``class_id`` is the smallest id of a class, a null id counting as
larger than any other; rows that repeat an id belong to the class of their own
text; an empty table gives no rows; other columns are ignored or passed on,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import any_order, fresh, mixed, raw_bytes, shared_dir, shingles, slices, span_hashes, stored, text_or_empty, words
from .graph import components

#: Words of a shingle, and the least similarity of a link.
WIDTH, SIMILAR = 5, 0.8
#: Bands and samples in each.
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Smoothing of document shares, and the share below which a shingle is rare.
SMOOTH, RARE = 0.2, 0.005
#: Hash functions and counters of the sketch, and counters that travel together.
SKETCH_ROWS, SKETCH_WIDTH, CHUNK = 3, 1 << 16, 1024
#: Tasks whose sketches are added first.
TEAM = 64
#: Nodes, and bytes of text, of one block in the comparison of mixed buckets.
BLOCK, BLOCK_BYTES = 768, 16 << 20

_SALTS = mixed(np.arange(1, SAMPLES + SKETCH_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def node_of(text: Column) -> Column:
    """A 64-bit hash of the word sequence."""
    return F.xxhash64(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, element) of all elements, by text and shingle in order."""
    data, offsets = raw_bytes(column)
    starts, ends, word_offsets = words(data, offsets)
    grams, by_text = shingles(span_hashes(data, starts, ends), word_offsets, WIDTH)
    text = np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    nth = np.arange(len(grams)) - first
    own = grams.copy()
    again = nth > 0
    own[again] = mixed(grams[again] + nth[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return text, grams, own


def _cells(grams: np.ndarray, row: int) -> np.ndarray:
    return ((grams * _SALTS[SAMPLES + row]) >> np.uint64(48)).astype(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.int64), 0
    for batch in batches:
        for part in slices(batch):
            text, grams, own = elements(part.column("text"))
            once = grams[grams == own]
            docs += len(np.unique(text))
            for r in range(SKETCH_ROWS):
                counts[r] += np.bincount(_cells(once, r), minlength=SKETCH_WIDTH)
    parts = counts.reshape(-1, CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_pydict(
        {
            "part": [-1, *used.tolist()],
            "team": [TaskContext.get().partitionId() // TEAM] * (len(used) + 1),
            "body": [zlib.compress(np.array([docs]).tobytes(), 1), *[zlib.compress(parts[k].tobytes(), 1) for k in used]],
        },
        schema=pa.schema([("part", pa.int32()), ("team", pa.int32()), ("body", pa.binary())]),
    )


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(b.as_py()), np.int64) for b in table.column("body"))
    return pa.table({"part": table.column("part").slice(0, 1), "team": table.column("team").slice(0, 1), "body": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def document_shares(docs: DataFrame) -> np.ndarray:
    """Corrected shares of documents by sketch cell. The driver gets one sketch, whose size is fixed."""
    kind = "part int, team int, body binary"
    parts = docs.select(text_or_empty().alias("text")).mapInArrow(_sketches, kind)
    # First by teams of tasks, then over teams, so that no group grows with the number of tasks alone.
    parts = parts.groupBy("part", "team").applyInArrow(_summed, kind).groupBy("part").applyInArrow(_summed, kind)
    counts, n = np.zeros((SKETCH_ROWS * SKETCH_WIDTH // CHUNK, CHUNK)), 0
    for row in parts.collect():
        values = np.frombuffer(zlib.decompress(row["body"]), np.int64)
        if row["part"] < 0:
            n = int(values[0])
        else:
            counts[row["part"]] = values
    counts = counts.reshape(SKETCH_ROWS, SKETCH_WIDTH)
    noise = (counts.sum(axis=1, keepdims=True) - counts) / (SKETCH_WIDTH - 1)
    return (np.maximum(counts - noise, 0) / max(n, 1)).astype(np.float32)


def weights(grams: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The IDF of each shingle, 1 for rare ones."""
    share = shares[0][_cells(grams, 0)]
    common = np.flatnonzero(share > RARE)
    for r in range(1, SKETCH_ROWS):
        share[common] = np.minimum(share[common], shares[r][_cells(grams[common], r)])
    out = np.ones(len(grams))
    common = common[share[common] > RARE]
    out[common] = np.log1p(1 / (share[common].astype(float) + SMOOTH)) / np.log1p(1 / SMOOTH)
    return out


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r and c from Gamma(2, 1), beta from [0, 1), and the sample key of weight 1, by place in the pool."""
    rng = np.random.default_rng(2010)
    n = 1 << 16
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    return r, beta, np.log(c), _ordered(np.log(c) + r * beta - r)


def _ordered(x: np.ndarray) -> np.ndarray:
    """32-bit keys, in the upper half of 64 bits, in the order of the floats."""
    bits = x.astype(np.float32).view(np.uint32)
    return (np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))).astype(np.uint64) << np.uint64(32)


_POOL = None


def samples(text: np.ndarray, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have elements, their SAMPLES sampled elements as 32-bit hashes)."""
    global _POOL
    _POOL = _POOL or _pool()
    r, beta, log_c, unit = _POOL
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    out = np.zeros((len(first), SAMPLES), np.uint32)
    if not len(first):
        return text[first], out
    low = own & np.uint64(0xFFFFFFFF)
    heavy = np.flatnonzero(weight != 1)
    log_w, heavy_low = np.log(weight[heavy]), low[heavy]
    for k in range(SAMPLES):
        at = (own * _SALTS[k]) >> np.uint64(48)
        key = unit[at]
        key |= low
        if len(heavy):
            a = at[heavy]
            t = np.floor(log_w / r[a] + beta[a])
            key[heavy] = _ordered(log_c[a] - r[a] * (t - beta[a]) - r[a]) | heavy_low
        out[:, k] = np.minimum.reduceat(key, first).astype(np.uint32)
    return text[first], out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys."""
    out = np.empty((len(sampled), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sampled), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sampled[:, k])
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, shares: Broadcast, id_col: str) -> DataFrame:
    """(id, node, text_hash, bands array<long>, size) of every row; bands is empty without a shingle, size is the text's bytes."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    rows = rows.withColumns({"node": node_of(F.col("text")), "text_hash": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, grams, own = elements(part.column("text"))
                have, sampled = samples(text, own, weights(grams, shares.value))
                counts = np.zeros(part.num_rows + 1, np.int32)
                counts[have + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(band_keys(sampled).ravel()))
                names = ["id", "node", "text_hash", "size"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), lists], names=[*names, "bands"])

    return rows.mapInArrow(run, f"id {kind}, node long, text_hash long, size long, bands array<long>")


def similarities(a: pa.Array, b: pa.Array, shares: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, pair by pair."""
    text_a, grams_a, own_a = elements(a)
    text_b, grams_b, own_b = elements(b)
    w_a, w_b = weights(grams_a, shares), weights(grams_b, shares)
    pair, own, w = np.concatenate([text_a, text_b]), np.concatenate([own_a, own_b]), np.concatenate([w_a, w_b])
    order = np.lexsort((own, pair))
    pair, own, w = pair[order], own[order], w[order]
    both = np.flatnonzero((own[1:] == own[:-1]) & (pair[1:] == pair[:-1]))
    shared = np.bincount(pair[both], w[both], len(a))
    total = np.bincount(pair, w, len(a))
    union = total - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def _verified(shares: Broadcast, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                like = similarities(part.column("text_a"), part.column("text_b"), shares.value) >= least
                keep = pa.array(like)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return run


def block_links(labels: np.ndarray, side: np.ndarray, column: pa.Array, shares: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between components within a block pair: enough of them to join all that are linked.

    ``side`` is 0 and 1 for two blocks, or 2 for all rows of one block. Similarities are matrix products
    over the elements that more than one row has, some thousand elements at a time.
    """
    text, grams, own = elements(column)
    w, n = weights(grams, shares), len(labels)
    total = np.bincount(text, w, n)
    kinds, place, counts = np.unique(own, return_inverse=True, return_counts=True)
    shared = counts[place] > 1
    text, place, w = text[shared], place[shared], w[shared]
    column_of = np.cumsum(counts > 1) - 1
    place = column_of[place]
    common, width = np.zeros((n, n)), 4096
    order = np.argsort(place, kind="stable")
    text, place, w = text[order], place[order], w[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        own_cells = slice(*np.searchsorted(place, [at, at + width]))
        m = np.zeros((n, width), np.float32)
        m[text[own_cells], place[own_cells] - at] = np.sqrt(w[own_cells])
        common += m @ m.T
    # Products in single precision only choose; what is near the threshold is summed again exactly.
    union = total[:, None] + total[None, :] - common
    near = common >= (least - 1e-3) * union
    near &= labels[:, None] != labels[None, :]
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    root = {x: x for x in set(labels.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b and (common[i, j] > (least + 1e-3) * union[i, j] or similarities(column.take(pa.array([i])), column.take(pa.array([j])), shares)[0] >= least):
            root[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def _block_groups(shares: Broadcast, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        labels = table.column("label").to_numpy()
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = np.full(len(labels), 2) if i == j else (own == j).astype(np.int64)
        text = table.column("text").combine_chunks()
        found = block_links(labels, side, text, shares.value, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _classified(docs: DataFrame, id_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """((id, node, root, class_id) of documents with a shingle, (id, node) of those without)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    shares = spark.sparkContext.broadcast(document_shares(docs))
    sigs = stored(signatures(docs, shares, id_col), f"{folder}/signatures")
    have = sigs.filter(F.size("bands") > 0)
    # The first row of a node: smallest id, null last.
    row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("row")
    nodes = have.groupBy("node").agg(row, F.first("bands").alias("bands"), F.max("size").alias("size"))
    nodes = stored(nodes.select("node", F.col("row.id").alias("least_id"), F.col("row.text_hash").alias("text_hash"), "bands", "size"), f"{folder}/nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    members = stored(members.drop("size").join(buckets, "bucket"), f"{folder}/members")
    pairs = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()

    needed = members.select("node").distinct().join(nodes.select("node", "least_id", "text_hash"), "node")
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    # By id and text, which only rows that repeat both share; null ids alone would meet each other.
    same = F.col("id").eqNullSafe(F.col("least_id")) & (F.xxhash64("text") == F.col("text_hash"))
    texts = stored(texts.join(needed, same).select("node", "text").dropDuplicates(["node"]), f"{folder}/texts")
    text_of = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    links = pairs.join(text_of("b"), "b").join(text_of("a"), "a").mapInArrow(_verified(shares, least), "a long, b long")
    labels = components(stored(links, f"{folder}/links"))

    # Buckets that hold several components; of buckets with the same nodes one is enough, and two nodes have been compared.
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled.filter("n > 2").select("bucket", "node", "label", "n", "bytes"), f"{folder}/labelled")
    marks = [F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two")]
    several = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *marks, F.first("n").alias("n")).filter("lo <> hi")
    several = several.groupBy("one", "two", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = labelled.join(several, "bucket").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    rows = rows.select("bucket", "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    more = rows.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(_block_groups(shares, least), "a long, b long")
    joined = components(stored(more, f"{folder}/more"))

    final = nodes.select("node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    final = final.join(joined.toDF("label", "root"), "label", "left").withColumn("root", F.coalesce("root", "label"))
    # min skips nulls; a class all of whose ids are null keeps a null.
    ids = final.groupBy("root").agg(F.min("least_id").alias("class_id"))
    final = stored(final.join(ids, "root").select("node", "root", "class_id"), f"{folder}/classes")
    return have.select("id", "node").join(final, "node").select("id", "node", "root", "class_id"), sigs.filter(F.size("bands") == 0).select("id", "node")


def near_classes(docs: DataFrame, id_col: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """One row per document: id, class_id, kept (whether it has the class's smallest id), node (hash of its words)."""
    classed, lone = _classified(docs, id_col, least)
    out = classed.select("id", "class_id", "node").unionByName(lone.withColumn("class_id", F.col("id")))
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "node")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """The documents that stay, with all their columns: of each class the one with the smallest id (null last); of rows
    that share it the one of the smallest node, then of the smallest text. Wordless documents all stay."""
    classed, lone = _classified(docs, id_col, least)
    best = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("w"))
    kept = best.select("w.id", "w.node").unionByName(lone).distinct()
    names = ("own_id", "no_id", "own_node", "apart", "their_id", "no_other", "their_node", "place")
    own_id, no_id, own_node, apart, their_id, no_other, their_node, place = fresh(docs, *names)
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = kept.select(text_of(F.col("id")).alias(their_id), F.col("id").isNull().alias(no_other), F.col("node").alias(their_node))
    rows = docs.withColumns({own_id: text_of(F.col(id_col)), no_id: F.col(id_col).isNull(), own_node: node_of(text_or_empty())})
    rows = rows.withColumn(apart, F.when(F.col(own_node) == node_of(F.lit("")), F.monotonically_increasing_id()))
    same = (F.col(own_id) == F.col(their_id)) & (F.col(no_id) == F.col(no_other)) & (F.col(own_node) == F.col(their_node))
    # The window needs no other partitioning than the join's.
    first = Window.partitionBy(own_id, no_id, own_node, apart).orderBy("text", any_order(docs))
    out = rows.join(kept.hint("merge"), same, "left_semi").withColumn(place, F.row_number().over(first))
    return out.filter(F.col(place) == 1).drop(own_id, no_id, own_node, apart, place)
