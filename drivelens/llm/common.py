"""Helpers shared by the text and media operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; make a temporary one only on a local master without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Texts that Spark hands to a Python worker at a time, at most; texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array; nulls count as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def spans_of_bytes(offsets: np.ndarray, limit: int):
    """Ranges (first, last + 1) of consecutive texts that hold about `limit` bytes together, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased: digits, a-z and all of UTF-8 beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, in order, and the number of words of each text.

    A word's hash is the polynomial in its lower-cased bytes, as the difference of prefix sums modulo 2**64.
    """
    n = len(body)
    low = LOWER[body]
    inside = np.zeros(n + 1, bool)
    inside[:n] = WORD_BYTE[low]
    starts = inside[:n].copy()
    starts[1:] &= ~inside[: n - 1]
    heads = offsets[:-1][offsets[:-1] < n]
    starts[heads] = inside[heads]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    ends = inside[:n] & ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    end = np.flatnonzero(ends) + 1
    if len(_CACHE.get("powers", ())) < n + 1:
        size = max(n + 1, 1 << 20)
        _CACHE["powers"], _CACHE["inverse"] = _powers(_BASE, size), _powers(_INVERSE, size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _CACHE["powers"][:n], out=total[1:])
    hashes = mix64((total[end] - total[begin]) * _CACHE["inverse"][begin])
    counts = np.searchsorted(begin, offsets[1:]) - np.searchsorted(begin, offsets[:-1])
    return hashes, counts


#: Edges that one task of a step of connected_components takes.
TASK_EDGES = 250_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge is connected to.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the edges stop changing;
    every step's edges are checkpointed. Tasks are as many as the edges need, for each writes files for all others.
    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(limit):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, tasks = now, max(1, -(-now[0] // TASK_EDGES))
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        joined = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u").coalesce(tasks)
        # every neighbour and the node itself go to the smallest
        small = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(small.distinct().coalesce(tasks))
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
