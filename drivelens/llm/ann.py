"""Approximate nearest neighbours by largest inner product, along shifted space-filling curves.

Equal vectors are one node. Nodes are lifted by one coordinate so that all have the same length, which turns the
largest inner product into the smallest distance; the length is one that few vectors exceed, and those are placed by
their direction. Several random projections, each shifted, give each node a key on a Hilbert curve; along each curve
the nodes are range-partitioned, numbered and cut into blocks. A query reads the blocks of the window around its place
on every curve, scores their original vectors exactly, and its windows' results are merged.

A window has a fixed width at first. A query whose nearest rows were mostly met on one curve only has not been
searched enough (on curves that see most neighbours, most are met again and again): it is searched anew with windows
`GROWTH` times as wide, until enough of its results are confirmed or its windows hold every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

NEAREST = 20
CURVES = 4
DIMENSIONS, BITS = 8, 7
BLOCK = 2048
#: Blocks of a window whose queries one task takes at most; a wider window's are dealt out.
SPAN = 32
#: Blocks on either side of a query's own in the first round, and by how much later rounds widen.
REACH, GROWTH = 1, 6
#: The longest vectors, so many, are compared with every query: they may be near to any, whatever their direction.
LONGEST = 256
#: Share of a query's results that may have been met on one curve only.
UNCONFIRMED = 0.25
SEED = 20240601


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n, dimensions), integers below 2 ** bits.

    The axes are turned into the curve's transposed index by undoing its reflections and exchanges from the highest
    bit down, then Gray-decoded; the bits of the axes are interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(cells.shape[0], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(cells.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(curve: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal directions of a curve, and its shift in cells."""
    rng = np.random.default_rng([SEED, curve, width])
    q, _ = np.linalg.qr(rng.normal(size=(width, max(1, min(DIMENSIONS, width)))))
    return q, rng.uniform(0, 1, q.shape[1])


def _key_udf(width: int, radius: float, curves: int):
    """Keys of each vector on every curve. radius: a length that few vectors exceed; longer ones are placed by their direction."""

    @F.arrow_udf("array<bigint>")
    def keys(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)
        # scaled by their largest component first, so that no square overflows
        top = np.abs(flat).max(1, keepdims=True)
        length = top[:, 0] * np.sqrt(((flat / top) ** 2).sum(1))
        unit = flat / radius * np.minimum(1, radius / length)[:, None]
        lift = np.sqrt(np.maximum(1 - (unit**2).sum(1), 0))
        flat = np.column_stack([unit, lift])
        out = []
        for c in range(curves):
            q, shift = _projection(c, width + 1)
            # six spreads of one coordinate of a vector on the sphere, and the shift's room, span the cells
            cells = np.floor((flat @ q / (6 / np.sqrt(width + 1)) + 0.5 + (shift - 0.5) / 8) * (1 << BITS))
            out.append(hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64)))
        keys = np.stack(out, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, curves), pa.int32()), pa.array(keys.ravel()))

    return keys


def usable(vectors: DataFrame, vector: str = "embedding", row: str = "vec_id") -> DataFrame:
    """vec_id, v (array<double>) of vectors that take part: not null, not empty, not zero, every component finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{row}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(good).filter(F.exists("v", lambda x: x != 0))


def _ranked(keyed: DataFrame, partitions: int) -> DataFrame:
    """(curve, node, v, block): nodes numbered along each curve's keys and cut into blocks.

    Nodes of one key are in an order of their own on every curve, so that what they meet on one says nothing about the others.
    """
    order = ["curve", "key", F.xxhash64("node", "curve")]
    placed = cut(keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("curve", "node", "v", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")))
    # how many nodes of a curve lie in the partitions before: a few numbers for each partition
    sizes = placed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("curve", "part", "first", before.alias("before"))
    at = F.col("before") + F.col("line") - F.col("first")
    return placed.join(starts, ["curve", "part"]).select("curve", "node", "v", (at / BLOCK).cast("long").alias("block"))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last: the same whatever else is computed with them."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


def _top(nodes: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, least: np.ndarray, nearest: int) -> pd.DataFrame:
    """query, node, score of the nearest of x to each of q, none below `least`; a few more where scores are all but equal."""
    out = []
    for a in range(0, len(asked), 256):
        part = slice(a, a + 256)
        scores = q[part] @ x.T
        scores[asked[part, None] == nodes[None, :]] = -np.inf
        k = min(nearest, len(nodes))
        bound = np.partition(scores, len(nodes) - k, axis=1)[:, len(nodes) - k]
        # a matrix product rounds otherwise than the sum in order: what may belong to the nearest is summed again
        room = 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0)) + 1e-12 * np.sqrt((q[part] ** 2).sum(1) * (x**2).sum(1).max())
        row, at = np.nonzero((scores > -np.inf) & (scores >= (np.maximum(bound, least[part]) - room)[:, None]))
        out.append(pd.DataFrame({"query": asked[part][row], "node": nodes[at], "score": inner_products(q[part][row], x[at])}))
    return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})


def _best(nearest: int):
    """Of the blocks of a curve: each query's nearest nodes in a block."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["query"].to_numpy()
        data, asked = rows[side == 0], rows[side == 1]
        if not len(data) or not len(asked):
            return pd.DataFrame({"query": [], "node": [], "score": [], "curve": []}).astype({"query": "int64", "node": "int64", "curve": "int32"})
        found = _top(data["node"].to_numpy(), np.stack(data["v"].to_numpy()), asked["node"].to_numpy(), np.stack(asked["v"].to_numpy()), asked["least"].to_numpy(), nearest)
        return found.assign(curve=np.int32(rows["curve"].iloc[0]))

    return best


def _search(ranked: DataFrame, queries: DataFrame, blocks: int, reach: int, nearest: int, long_nodes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(query, node, score, met): the nearest nodes of each query in its windows, and on how many curves each was met.

    queries: node, v and least, the score of the last of its nearest nodes in narrower windows. The longest vectors are
    compared with every query, beside its windows.
    """
    first, last = F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))
    if reach >= blocks:
        # such windows hold every node of any curve: one is enough
        ranked = ranked.filter("curve = 0")
    slots = -(-min(2 * reach + 1, blocks) // SPAN)
    asked = ranked.join(queries.select("node", "least"), "node").select("curve", "node", "v", F.explode(F.sequence(first, last)).alias("block"), F.pmod(F.xxhash64("node"), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("query"), "least")
    data = ranked.select("curve", "node", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("query"), F.lit(None).cast("double").alias("least"))
    schema = "query long, node long, score double, curve int"
    found = data.unionByName(asked).groupBy("curve", "block", "slot").applyInPandas(_best(nearest), schema)

    def with_long(parts):
        for rows in parts:
            if len(rows):
                near = _top(*long_nodes, rows["node"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["least"].to_numpy(), nearest)
                yield pd.concat([near.assign(curve=np.int32(c)) for c in (-1, -2)])

    found = found.unionByName(queries.select("node", "v", "least").mapInPandas(with_long, schema))
    merged = found.groupBy("query", "node").agg(F.max("score").alias("score"), F.countDistinct("curve").alias("met"))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(F.col("place") <= nearest)


def _radius(nodes: DataFrame) -> float:
    """A length that one in a hundred vectors exceeds, up to an eighth of a doubling; counted over all of them."""
    classes = nodes.groupBy(F.floor(F.log2("length") * 8).alias("c")).count().orderBy("c").collect()
    wanted, seen = 0.99 * sum(r["count"] for r in classes), 0
    for r in classes:
        seen += r["count"]
        if seen >= wanted:
            break
    return float(min(2.0 ** ((r["c"] + 1) / 8), 1e300))


def _of_width(rows: DataFrame, width: int, is_query, nearest: int, curves: int) -> DataFrame:
    """nearest_rows among vectors of one width. rows: vec_id, v."""
    spark = rows.sparkSession
    single = rows.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    # of equal vectors, only as many ids as can be a query's nearest
    first = single.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= nearest + 1)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", F.least("n", F.lit(nearest + 1)).alias("n")))).alias("ids")
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    length = top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))
    # numbered by the smallest id, so that ties of different vectors fall to it; the checkpoint holds the numbers
    numbered = first.groupBy("v").agg(ids).repartitionByRange(F.col("ids")[0]["vec_id"], F.xxhash64("v")).sortWithinPartitions(F.col("ids")[0]["vec_id"], F.xxhash64("v"))
    nodes = cut(numbered.select(F.monotonically_increasing_id().alias("node"), "v", "ids", length.alias("length")))
    asking = single.filter(is_query).join(nodes.select("v", "node"), "v").select("vec_id", "n", "node")
    asking = cut(asking)
    total = nodes.count()
    longest = nodes.orderBy(F.desc("length"), "node").limit(LONGEST).select("node", "v").collect()
    long_nodes = np.array([r["node"] for r in longest], np.int64), np.array([r["v"] for r in longest], np.float64).reshape(len(longest), width)
    keys = _key_udf(width, _radius(nodes), curves)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * curves)
    ranked = cut(_ranked(nodes.select("node", "v", F.posexplode(keys("v")).alias("curve", "key")), partitions))
    blocks = -(-total // BLOCK)
    left = nodes.select("node", "v").join(asking.select("node").distinct(), "node").withColumn("least", F.lit(float("-inf")))
    done, reach = [], REACH
    while True:
        found = cut(_search(ranked, left, blocks, reach, nearest, long_nodes))
        if reach >= blocks:
            done.append(found)
            break
        doubt = found.groupBy("query").agg(F.count("*").alias("k"), F.sum((F.col("met") < 2).cast("int")).alias("once"), F.min("score").alias("low"))
        doubt = doubt.filter((F.col("once") > F.col("k") * UNCONFIRMED) | (F.col("k") < nearest))
        # a query that met nothing is not in doubt, but unanswered
        open_nodes = left.join(found.select(F.col("query").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(float("-inf")).alias("least"))
        wider = doubt.select(F.col("query").alias("node"), F.when(F.col("k") >= nearest, F.col("low")).otherwise(F.lit(float("-inf"))).alias("least")).unionByName(open_nodes)
        # wider windows hold the narrower ones, so what was found is found again
        left = cut(left.select("node", "v").join(wider, "node"))
        done.append(found.join(left.select(F.col("node").alias("query")), "query", "left_anti"))
        if left.isEmpty():
            break
        reach = min(reach * GROWTH, blocks)
    near = done[0]
    for part in done[1:]:
        near = near.unionByName(part)
    # of each query's vector: the nodes near it and, as rows of the same vector are near too, itself
    own = nodes.join(asking.select("node").distinct(), "node").select(F.col("node").alias("query"), "node", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("score"), F.lit(curves).cast("long").alias("met"), "ids")
    listed = near.join(nodes.select("node", "ids"), "node").select("query", "node", "score", "met", "ids").unionByName(own)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "copy")
    copies = listed.select("query", "score", "met", F.explode("ids").alias("i")).select("query", "score", "met", "i.vec_id", F.explode(F.sequence(F.lit(1), F.col("i.n").cast("int"))).alias("copy"))
    best = copies.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= nearest + 1).select("query", "score", "met", "vec_id", "place")
    # a query leaves out one row of its own id and vector: the first, as all of them are alike
    answers = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("again")).join(best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "met"))).alias("near")), "query")
    mine = answers.join(own.select("query", F.col("score").alias("square")), "query")
    at = F.array_position(F.transform("near", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("square"))), F.lit(True))
    kept = mine.withColumn("near", F.filter("near", lambda x, i: i + 1 != at)).select("query_id", F.posexplode(F.slice("near", 1, nearest)).alias("i", "x"))
    return kept.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score", F.col("x.met").cast("int").alias("met"))


def nearest_rows(vectors: DataFrame, is_query, nearest: int = NEAREST, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score, met of the rows of vectors (vec_id, embedding) nearest to those that is_query marks.

    Score is the inner product of the original vectors in double precision, summed in the order of their components;
    the nearest come first, ties by vec_id. met: on how many curves the vector was met. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do rows without an id. Every other row is indexed and
    a candidate, rows of equal ids or vectors too; a row that repeats is asked as often as it is there. Vectors of
    different widths have no inner product: each width is searched by itself. Other columns are not read. No usable
    rows give no result.
    """
    good = cut(usable(vectors))
    widths = sorted(r["w"] for r in good.select(F.size("v").alias("w")).distinct().collect())
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, met int")
    for width in widths:
        out = out.unionByName(_of_width(good.filter(F.size("v") == width), width, is_query, nearest, curves))
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    return nearest_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
