"""Byte-level BPE with overlapping chunks.

A text of at most `CHUNK` characters is one piece. A longer one is cut into chunks that overlap by `OVERLAP`
characters and are pre-tokenised in parallel. Where a boundary of one chunk's pre-tokens is a boundary of the next
chunk's too, the two have resynchronised (a pre-token depends only on what follows its start), and the text is cut
there. The pieces between such cuts are encoded in parallel; a text is put together again from the ids of its pieces
in order, a piece at a time. A text with an overlap without a shared boundary is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches

CHUNK = 1 << 15
OVERLAP = 1 << 10


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _vocabulary(ranks_path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Every id's bytes after one another, and where each id's begin and, at last, end."""
    enc = encoding(ranks_path, pattern)
    parts = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@functools.lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Ids of a piece, without special tokens."""
    return encoding(ranks_path, pattern).encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)


def decode(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    """The raw bytes of ids, one after another."""
    body, starts = _vocabulary(ranks_path, pattern)
    sizes = np.diff(starts)[ids]
    shift = starts[ids] - (np.cumsum(sizes) - sizes)
    return body[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of a chunk, and its end."""
    return [m.start() for m in _splitter(pattern).finditer(text)] + [len(text)]


def chunks(text: str, chunk: int, overlap: int):
    """(number, start, text) of the overlapping chunks."""
    for k, a in enumerate(range(0, len(text), chunk)):
        yield k, a, text[a : a + chunk + overlap]


def seams(part: str, start: int, last: bool, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries in the whole text that a chunk finds in the overlap at its head and in that at its tail.

    At the tail, the pre-token that touches the chunk's end, and the one before it, may be different in the whole text.
    """
    at = boundaries(part, pattern)
    head = [start + p for p in at if p < overlap] if start else []
    tail = [start + p for p in at[:-2] if p >= chunk] if not last else []
    return head, tail


def _digests(ranks_path: str, pattern: str):
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        n, ids_sha, decoded_sha = [], [], []
        for value in texts:
            ids = encode(value.as_py() or "", ranks_path, pattern)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(decode(ids, ranks_path, pattern)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _piece(ranks_path: str, pattern: str):
    @F.arrow_udf("binary")
    def piece(texts: pa.Array) -> pa.Array:
        return pa.array([encode(v.as_py(), ranks_path, pattern).tobytes() for v in texts], pa.binary())

    return piece


def _joined(ranks_path: str, pattern: str):
    """(key, n_tokens, ids_sha256, decoded_sha256) of texts whose pieces follow one another; a piece is held at a time."""

    def joined(batches):
        key, n, digests = None, 0, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, n, *(d.hexdigest() for d in digests))], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            for own, piece in zip(batch.column("key"), batch.column("ids"), strict=True):
                if own.as_py() != key:
                    if digests:
                        yield done()
                    key, n, digests = own.as_py(), 0, (hashlib.sha256(), hashlib.sha256())
                ids = np.frombuffer(piece.as_py(), "<u4")
                n += len(ids)
                digests[0].update(ids)
                digests[1].update(decode(ids, ranks_path, pattern))
        if digests:
            yield done()

    return joined


def _cut(chunk: int, overlap: int):
    @F.arrow_udf("array<struct<k:int,start:bigint,last:boolean,part:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            found = list(chunks(value.as_py(), chunk, overlap))
            rows.append([{"k": k, "start": a, "last": k == len(found) - 1, "part": p} for k, a, p in found])
        return pa.array(rows, pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])))

    return cut


def _seams(pattern: str, chunk: int, overlap: int):
    @F.arrow_udf("struct<head:array<bigint>,tail:array<bigint>>")
    def find(parts: pa.Array, starts: pa.Array, lasts: pa.Array) -> pa.Array:
        found = [seams(p, a, z, pattern, chunk, overlap) for p, a, z in zip(parts.to_pylist(), starts.to_pylist(), lasts.to_pylist(), strict=True)]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([h for h, _ in found], kind), pa.array([t for _, t in found], kind)], ["head", "tail"])

    return find


def _long_pieces(keyed: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, piece) of texts longer than a chunk; keyed: key, text."""
    n = max(keyed.sparkSession.sparkContext.defaultParallelism, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = keyed.select("key", F.explode(_cut(chunk, overlap)("text")).alias("c")).select("key", "c.*").repartition(n, "key", "k")
    found = parts.select("*", _seams(pattern, chunk, overlap)("part", "start", "last").alias("s"))
    order = Window.partitionBy("key").orderBy("k")
    # a seam is the first boundary that both sides of an overlap share; null where there is none
    seam = F.array_min(F.array_intersect(F.lag("s.tail").over(order), "s.head"))
    placed = found.select("key", "k", "start", "last", "part", seam.alias("from"))
    ends = placed.select("*", F.lead("from").over(order).alias("to"), F.bool_and(F.col("k").eqNullSafe(0) | F.col("from").isNotNull()).over(Window.partitionBy("key")).alias("whole"))
    good = ends.filter("whole").select("key", "k", F.expr("substring(part, cast(coalesce(`from`, 0) - start + 1 as int), cast(coalesce(`to`, start + length(part)) - coalesce(`from`, 0) as int))").alias("piece"))
    lost = ends.filter("not whole and k = 0").select("key").join(keyed, "key").select("key", F.lit(0).alias("k"), F.col("text").alias("piece"))
    return good.unionByName(lost).repartition(n, "key", "k")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of the whole text.

    Null and empty texts have no ids. Input columns of the same names are replaced, other extra columns stay; repeated
    rows each get their result; an empty table stays empty. Only texts longer than a chunk are shuffled.
    """
    small_batches(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in names]
    own = [F.col(f"`{c}`") for c in kept]
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.filter(~is_long).select(*own, _digests(ranks_path, pattern)("text").alias("__d")).select(*own, *[F.col(f"__d.{n}").alias(n) for n in names])
    # equal texts have equal ids: a long text is encoded once and joined to its rows
    texts = docs.filter(is_long).select(*own, F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    keyed = texts.select("key", "text").dropDuplicates(["key"])
    pieces = _long_pieces(keyed, pattern, chunk, overlap).select("key", "k", _piece(ranks_path, pattern)("piece").alias("ids"))
    # a digest reads a text's pieces in order, so they meet in one task, where they stream through it
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pieces.repartition(tasks, "key").sortWithinPartitions("key", "k").select("key", "ids")
    done = met.mapInArrow(_joined(ranks_path, pattern), "key string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return short.unionByName(texts.join(done, "key").select(*own, *names))


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs.select("doc_id", "text"), *tokenizer()).drop("text")
