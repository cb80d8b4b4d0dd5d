"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

Every shingle of a text starts a Poisson process whose rate is the shingle's count; each arrival falls into one of
`REGISTERS` registers, and a register keeps its first arrival's shingle. Two texts agree in a register with the
probability Jaccard similarity of their shingle counts. Bands of registers propose pairs, which the exact similarity
of the shingle counts then confirms.

Groups are never expanded into all pairs. Equal texts are one node. In a bucket, every node is compared with the hub,
the node that meets most others over all its buckets, and with the one that meets fewest. What these leave unconnected
in a bucket of four nodes or more is compared with every node of the bucket, in blocks, where pairs that are connected
already are skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, mix64, small_batches, spans_of_bytes, utf8_parts, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 64
BAND_ROWS = 4
#: Nodes of a bucket that meet what is not connected with them in one task.
BLOCK = 512
_SLICE, _DOCS = 1 << 22, 2048
_C = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 52) - 1)


def _mul(x: int, y: np.uint64) -> np.uint64:
    return np.uint64((x * int(y)) & (1 << 64) - 1)


def shingle_counts(offsets: np.ndarray, body: np.ndarray, words: int = SHINGLE_WORDS):
    """(text, 52-bit shingle hash, count) of all texts, sorted by text and hash.

    A text of fewer words, but at least one, has one shingle of all its words; one without words has none.
    """
    hashes, counts = word_hashes(offsets, body)
    n = len(hashes)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    shingle = np.zeros(n, np.uint64)
    place = np.arange(n)
    for j in range(words):
        part = mix64(hashes + _mul(j + 1, _C))
        rolled = np.zeros(n, np.uint64)
        if n > j:
            rolled[: n - j] = part[j:]
        shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + np.where(place + j < ends[text], rolled, np.uint64(0))
    whole = (place + words <= ends[text]) | (place == (ends - counts)[text])
    text, shingle = text[whole], mix64(shingle[whole]) & _LOW
    key = np.sort((text.astype(np.uint64) << np.uint64(52)) | shingle)
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(52)).astype(np.int64), key & _LOW, weight


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) winning shingles; rows of texts without shingles are 0.

    Arrivals stop at a horizon after which a text's registers are nearly surely full; where one is still empty, the
    horizon doubles. Arrivals before a horizon are all made, so the result does not depend on it.
    """
    out = np.zeros(texts * registers, np.uint64)
    total = np.bincount(text, weight, texts)
    horizon = registers * (np.log(registers) + 6.0) / np.maximum(total, 1)
    pending = total > 0
    while pending.any():
        use = np.flatnonzero(pending[text])
        best = np.full(texts * registers, np.inf)
        arrive = np.zeros(len(use))
        points = []
        j = 0
        while len(use):
            seed = mix64(shingle[use] + _mul(2 * j + 1, _C))
            arrive = arrive - np.log(_uniform(seed)) / weight[use]
            alive = arrive < horizon[text[use]]
            use, arrive, seed = use[alive], arrive[alive], seed[alive]
            slot = text[use] * registers + (mix64(seed + _C) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(best, slot, arrive)
            points.append((slot, arrive, use))
            j += 1
        for slot, when, at in points:
            won = best[slot] == when
            out[slot[won]] = shingle[at[won]]
        pending = pending & np.isinf(best.reshape(texts, registers)).any(1)
        horizon = horizon * 2
    return out.reshape(texts, registers)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact similarity of two sorted shingle arrays with counts: the sum over shared shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = b[at] == a
    if not shared.any():
        return 0.0
    x, y = wa[shared].astype(np.float64), wb[at[shared]].astype(np.float64)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratios, inverse = np.unique(x / y, return_inverse=True)
    if len(ratios) * len(x) <= 1 << 22:
        both = np.maximum(x[None, :], ratios[:, None] * y[None, :]).sum(1)
    else:
        both = np.array([np.maximum(x, r * y).sum() for r in ratios])
    return float((x / (both + only_a + ratios * only_b)[inverse]).sum())


def _slices(texts: pa.Array):
    offsets, body = utf8_parts(texts)
    for first, last in spans_of_bytes(offsets, _SLICE):
        for a in range(first, last, _DOCS):
            b = min(a + _DOCS, last)
            yield b - a, shingle_counts(offsets[a : b + 1] - offsets[a], body[offsets[a] : offsets[b]])


@F.arrow_udf(T.ArrayType(T.LongType()))
def band_keys(texts: pa.Array) -> pa.Array:
    """Keys of the bands of each text; none for a text without words."""
    rows = []
    bands = REGISTERS // BAND_ROWS
    for n, (text, shingle, weight) in _slices(texts):
        found = signatures(text, shingle, weight, n).reshape(n, bands, BAND_ROWS)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, (n, bands)).copy()
        for r in range(BAND_ROWS):
            key = mix64(key ^ mix64(found[:, :, r] + _mul(r + 1, _C)))
        some = np.bincount(text, minlength=n) > 0
        rows += [k if s else None for k, s in zip(key.view(np.int64), some, strict=True)]
    return pa.array(rows, pa.list_(pa.int64()))


@F.arrow_udf(T.StructType([T.StructField(n, T.BinaryType()) for n in ("hashes", "weights")]))
def shingle_arrays(texts: pa.Array) -> pa.Array:
    """Sorted shingles of each text and their counts."""
    hashes, weights = [], []
    for n, (text, shingle, weight) in _slices(texts):
        ends = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            hashes.append(shingle[ends[i] : ends[i + 1]].tobytes())
            weights.append(weight[ends[i] : ends[i + 1]].astype(np.uint32).tobytes())
    return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in (hashes, weights)], ["hashes", "weights"])


def _counts(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(weights, np.uint32)


@F.arrow_udf(T.DoubleType())
def exact_similarity(ha: pa.Array, wa: pa.Array, hb: pa.Array, wb: pa.Array) -> pa.Array:
    rows = zip(ha.to_pylist(), wa.to_pylist(), hb.to_pylist(), wb.to_pylist(), strict=True)
    return pa.array([probability_jaccard(*_counts(a, x), *_counts(b, y)) for a, x, b, y in rows], pa.float64())


def _compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of the nodes that ask (side 1) with those of a block (side 0), as a forest: pairs connected already are skipped.

    An index from shingles to the block's nodes gives what an asking node shares with each of them. Where all counts
    are 1 that is the similarity. For other pairs, the sum over shared shingles of the lesser of their two shares is
    never below it; where that reaches the wanted similarity, the similarity is computed.
    """
    rows = rows.reset_index(drop=True)
    counted = [_counts(h, w) for h, w in zip(rows["hashes"], rows["weights"], strict=True)]
    _, label = np.unique(rows["label"].map(bytes), return_inverse=True)
    side, size = rows["side"].to_numpy(), np.array([len(h) for h, _ in counted])
    plain = np.array([bool((w == 1).all()) for _, w in counted])
    block, found = np.flatnonzero(side == 0), []
    index = np.concatenate([counted[q][0] for q in block] or [np.zeros(0, np.uint64)])
    part = np.concatenate([counted[q][1] / counted[q][1].sum() for q in block] or [np.zeros(0)])
    order = np.argsort(index, kind="stable")
    index, part, owner = index[order], part[order], np.repeat(np.arange(len(block)), size[block])[order]
    for p in np.flatnonzero(side == 1):
        low, high = np.searchsorted(index, counted[p][0], "left"), np.searchsorted(index, counted[p][0], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(block))
        apart = label[block] != label[p]
        simple = plain[block] & plain[p]
        for q in block[apart & simple & (shared >= SIMILARITY * (size[p] + size[block] - shared))]:
            if label[p] != label[q]:
                found.append((rows["node"][p], rows["node"][q]))
                label[label == label[q]] = label[p]
        if simple.all():
            continue
        weights = counted[p][1]
        bound = np.bincount(owner[at], np.minimum(part[at], np.repeat(weights / weights.sum(), n)), len(block))
        for q in block[apart & ~simple & (bound >= SIMILARITY - 1e-9)]:
            if label[p] != label[q] and probability_jaccard(*counted[p], *counted[q]) >= SIMILARITY:
                found.append((rows["node"][p], rows["node"][q]))
                label[label == label[q]] = label[p]
    return pd.DataFrame(found, columns=["a", "b"])


def _links(docs: DataFrame, exact: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link. docs: doc_id, text, node."""
    bands = docs.select("node", F.explode(band_keys("text")).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low <> high")
    shared = cut(bands.join(buckets.select("key", "n"), "key").groupBy("key", "node").agg(F.first("n").alias("n")))
    meets = shared.groupBy("node").agg(F.struct(F.sum("n").alias("meets"), "node").alias("order"))
    placed = shared.join(meets, "node").select("key", "node", "order")
    ends = placed.groupBy("key").agg(F.max("order")["node"].alias("hub"), F.min("order")["node"].alias("far"))
    members = cut(placed.select("key", "node").join(ends, "key"))
    needed = meets.select("node").join(exact, "node").select("node", F.col("first_id").alias("doc_id"))
    same = (docs["node"] == needed["node"]) & docs["doc_id"].eqNullSafe(needed["doc_id"])
    texts = docs.join(needed, same, "inner").select(docs["node"], docs["doc_id"], docs["text"]).dropDuplicates(["node", "doc_id"])
    shingles = cut(texts.select("node", shingle_arrays("text").alias("s")).select("node", "s.*"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = shingles.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
        right = shingles.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
        both = pairs.join(left, "b").join(right, "a")
        return both.select("a", "b", exact_similarity("ha", "wa", "hb", "wb").alias("s")).filter(F.col("s") >= SIMILARITY).select("a", "b")

    edges = cut(verified(members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()))
    # nodes with a hub in common need no comparison
    linked = edges.unionByName(edges.select("a", F.col("a").alias("b"))).groupBy("b").agg(F.min("a").alias("label"))
    labelled = members.join(linked.withColumnRenamed("b", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_far = linked.select(F.col("b").alias("far"), F.col("label").alias("of_far"))
    apart = labelled.filter("node <> hub and node <> far").join(of_far, "far", "left").filter(F.col("label") != F.coalesce("of_far", "far"))
    edges = edges.unionByName(cut(verified(apart.select(F.col("far").alias("a"), F.col("node").alias("b")).distinct())))
    groups = connected_components(edges)
    labelled = members.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_buckets = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("largest")).filter("n >= 4 and labels > 1")
    rows = labelled.join(open_buckets.select("key", "largest", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    # every node lies in one block; those outside of the bucket's largest group ask all of its blocks
    data = rows.select("key", "node", "label", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"))
    asked = rows.filter("label <> largest").select("key", "node", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"))
    rest = data.unionByName(asked).join(shingles, "node").groupBy("key", "block").applyInPandas(_compare_block, "a binary, b binary")
    edges = edges.unionByName(cut(rest.distinct()))
    return connected_components(edges)


def _classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, node (md5 of the text), root (the class's smallest node), class_id, class_size."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.when(F.length("text") > 0, F.unhex(F.md5(F.col("text").cast("binary")))).alias("node"))
    filled = keyed.filter("node is not null")
    exact = cut(filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    linked = _links(filled, exact).withColumnRenamed("component", "root")
    rooted = exact.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    classes = rooted.select("node", "root").join(classes, "root").select("node", "root", "class_id", "class_size")
    names = ["doc_id", "node", "root", "class_id", "class_size"]
    found = filled.select("doc_id", "node").join(classes, "node").select(*names)
    none = keyed.filter("node is null")
    return found.unionByName(none.select("doc_id", "node", F.col("node").alias("root"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, node (md5 of the text), class_id, class_size.

    A class is a connected component of texts that are equal or have a probability Jaccard similarity of 0.8 or more
    of their five-word shingles; class_id is its smallest doc_id (null if all are null). Null and empty texts are a
    class each, with node null; texts without a word belong together only if they are equal. Repeated rows and ids
    stay rows of their own. Other columns are not read; an empty table gives no rows.
    """
    return _classes(docs).drop("root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each class the row with the smallest doc_id (any one if several have it).

    Classes are told apart by their texts, not by class_id: ids may be null or repeat. Null and empty texts all stay.
    All columns are returned as they came, whatever they are called; an empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    node = F.when(F.length("text") > 0, F.unhex(F.md5(F.col("text").cast("binary")))).alias("node")
    classes = _classes(docs).filter("node is not null")
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("best_id"), F.col("k.node").alias("best_node"))
    keyed = docs.select(whole, node)
    full = keyed.filter("node is not null")
    kept = full.join(best, (full["node"] == best["best_node"]) & full["row.doc_id"].eqNullSafe(best["best_id"]), "inner")
    # of rows with the same text and id, any one
    kept = kept.groupBy("best_node", "best_id").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(keyed.filter("node is null").select("row.*"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id", "class_size")
