"""Language identification by prediction by partial matching.

Each language has a context tree over bytes with contexts of up to `order` bytes. Its statistics are frozen after
fitting: the code length of a byte under its longest known context is found once for every context and byte,
escapes and exclusions included, so that scoring a text is a walk through tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, id_remainder, small_batches, spans_of_bytes, utf8_parts

#: Training rows of each language and the largest training text in bytes: these bound what fitting reads.
ROWS_PER_LANGUAGE = 240
LONGEST_TRAINING_TEXT = 32768
ORDER = 4
MAX_NODES = 6000
#: What a byte takes that is not coded at all.
RAW_BITS = 8.0
#: A text's score compares languages over this many bytes of its mean code length.
SCORE_BYTES = 16
_SLICE = 1 << 20


@dataclass
class ContextTrees:
    """languages; symbol (256 -> alphabet, 0 is the start of a text); child (node, symbol) -> node or -1; bits (node * symbols + symbol, language)."""

    languages: list[str]
    symbol: np.ndarray
    child: np.ndarray
    bits: np.ndarray
    order: int

    def code_lengths(self, offsets: np.ndarray, body: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, max(1, len(self.languages))), np.float64)
        for first, last in spans_of_bytes(offsets, _SLICE):
            part = body[offsets[first] : offsets[last]]
            if last == first + 1 and len(part) > _SLICE:
                for a in range(0, len(part), _SLICE):
                    back = min(a, self.order)
                    out[first] += self._bits(np.array([0, len(part[a - back : a + _SLICE])]), part[a - back : a + _SLICE], back)[0]
            else:
                out[first:last] = self._bits(offsets[first : last + 1] - offsets[first], part, 0)
        return out

    def _bits(self, offsets: np.ndarray, body: np.ndarray, skip: int) -> np.ndarray:
        """skip: leading bytes that are context only; a text that starts with such bytes has no start symbols."""
        n, k, size = len(offsets) - 1, self.order, self.child.shape[1]
        pad = 0 if skip else k
        where = np.arange(len(body), dtype=np.int64) + np.repeat(np.arange(1, n + 1) * pad, np.diff(offsets))
        line = np.zeros(len(body) + n * pad + (k if skip else 0), np.int32)
        if skip:
            where = where + k
        line[where] = self.symbol[body]
        node = np.zeros(len(where), np.int32)
        alive = np.arange(len(where))
        flat = self.child.ravel()
        for j in range(1, k + 1):
            step = flat[node[alive] * size + line[where[alive] - j]]
            good = step >= 0
            alive, step = alive[good], step[good]
            node[alive] = step
        cost = np.take(self.bits, node * size + line[where], axis=0)
        if skip:
            cost[:skip] = 0
        filled = np.flatnonzero(np.diff(offsets))
        out = np.zeros((n, self.bits.shape[1]), np.float64)
        if len(filled):
            out[filled] = np.add.reduceat(cost, offsets[:-1][filled], axis=0, dtype=np.float64)
        return out


def fit_trees(texts: list[tuple[str, str]], order: int = ORDER, max_nodes: int = MAX_NODES) -> ContextTrees:
    """Context trees of (language, text) pairs; no pairs give trees without languages."""
    languages = sorted({lang for lang, _ in texts})
    by = {lang: [t.encode() for x, t in texts if x == lang and t] for lang in languages}
    used = np.unique(np.frombuffer(b"".join(b"".join(v) for v in by.values()), np.uint8))
    symbol = np.full(256, len(used) + 1, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    size = len(used) + 2
    seen: list[dict] = []
    for lang in languages:
        line = np.concatenate([np.concatenate([np.zeros(order, np.int64), symbol[np.frombuffer(t, np.uint8)]]) for t in by[lang]] or [np.zeros(0, np.int64)])
        here = np.flatnonzero(line)
        seen.append({})
        key, base = line[here].copy(), 1
        for k in range(order + 1):
            pairs, counts = np.unique(key, return_counts=True)
            seen[-1][k] = (pairs, counts)
            if k < order:
                base *= size
                key = key + line[here - k - 1] * base
    # contexts as numbers: symbol j before the present one times size ** (j - 1)
    child = np.full((1, size), -1, np.int32)
    level_context, level_node = np.zeros(1, np.int64), np.zeros(1, np.int32)
    nodes = [(0, np.zeros(1, np.int64), np.full(1, -1))]
    total = 1
    for k in range(1, order + 1):
        if not languages:
            break
        contexts = np.concatenate([seen[i][k][0] // size for i in range(len(languages))])
        weights = np.concatenate([seen[i][k][1] for i in range(len(languages))])
        unique, inverse = np.unique(contexts, return_inverse=True)
        weight = np.bincount(inverse, weights)
        parent_at = np.searchsorted(level_context, unique % (size ** (k - 1)))
        parent_at = np.minimum(parent_at, len(level_context) - 1)
        known = level_context[parent_at] == unique % (size ** (k - 1))
        room = (max_nodes - total) // 2 if k < order else max_nodes - total
        keep = np.flatnonzero(known & (weight >= 4))
        keep = np.sort(keep[np.lexsort((unique[keep], -weight[keep]))][: max(room, 0)])
        if not len(keep):
            break
        ids = np.arange(total, total + len(keep), dtype=np.int32)
        child = np.vstack([child, np.full((len(keep), size), -1, np.int32)])
        parents = level_node[parent_at[keep]]
        child[parents, unique[keep] // (size ** (k - 1))] = ids
        nodes.append((k, unique[keep], parents))
        level_context, level_node = unique[keep], ids
        total += len(keep)
    bits = np.zeros((total, size, max(1, len(languages))), np.float32)
    for i in range(len(languages)):
        prob = np.full((total, size), 1.0 / size)
        done = 0
        for k, contexts, parents in nodes:
            pairs, counts = seen[i][k]
            at = np.searchsorted(contexts, pairs // size)
            at = np.minimum(at, len(contexts) - 1)
            hit = contexts[at] == pairs // size
            table = np.zeros((len(contexts), size))
            table[at[hit], pairs[hit] % size] = counts[hit]
            n, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            lower = np.full((1, size), 1.0 / size) if k == 0 else prob[parents]
            left = np.where(table > 0, 0.0, lower)
            mass = left.sum(1, keepdims=True)
            escape = np.where(mass > 1e-12, kinds / np.maximum(n + kinds, 1), 0.0)
            own = (1 - escape) * table / np.maximum(n, 1)
            mixed = np.where(table > 0, own, escape * left / np.maximum(mass, 1e-12))
            prob[done : done + len(contexts)] = np.where(n > 0, mixed, lower)
            done += len(contexts)
        bits[:, :, i] = -np.log2(np.maximum(prob, 1e-12))
    return ContextTrees(languages, symbol, child, bits.reshape(total * size, -1), order)


def fit_language_model(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, longest: int = LONGEST_TRAINING_TEXT) -> ContextTrees:
    """Fit on at most `rows_per_language` whole texts of each language, none longer than `longest` bytes.

    Of a language whose texts are all longer, the shortest are taken, with as many bytes together as those would have
    at most; of one that exceeds this alone, its beginning. Rows without text or lang, and rows whose crc32(doc_id as
    text) is divisible by 5, are never used. Hashes of ids and texts choose the rows, so a rerun takes the same ones.
    """
    size = F.octet_length("text")
    known = docs.filter(F.col("lang").isNotNull() & (size > 0) & (id_remainder("doc_id", 5) != 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_if(size <= longest).alias("n")).collect()}
    if not counts:
        return fit_trees([])
    # a few times as many rows as are wanted pass by their hash, so that few texts are shuffled however many there are
    part = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 6 * rows_per_language / max(n, 1))))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.filter((place < part[F.col("lang")]) & (size <= longest))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"))
    ids = rows.select("lang", "doc_id", "text").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows_per_language).select("lang", "text")
    if lengthy := [lang for lang, n in counts.items() if not n]:
        room = rows_per_language * longest
        least = Window.partitionBy("lang").orderBy(size, F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"))
        few = known.filter(F.col("lang").isin(lengthy)).select("lang", "doc_id", "text").withColumn("n", F.row_number().over(least)).filter(F.col("n") <= rows_per_language)
        few = few.withColumn("total", F.sum(size).over(Window.partitionBy("lang").orderBy("n"))).filter((F.col("n") == 1) | (F.col("total") <= room))
        ids = ids.unionByName(few.select("lang", F.substring("text", 1, room).alias("text")))
    return fit_trees([(r["lang"], r["text"]) for r in ids.collect()])


def has_letters(offsets: np.ndarray, body: np.ndarray) -> np.ndarray:
    plain = np.zeros(256, np.int64)
    plain[0x41:0x5B] = plain[0x61:0x7B] = 1
    sums = np.concatenate([[0], np.cumsum(plain[body])])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in body[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


@F.arrow_udf(T.BooleanType())
def _with_letters(texts: pa.Array) -> pa.Array:
    return pa.array(has_letters(*utf8_parts(texts)))


def language_udf(spark, model: ContextTrees):
    """A column function from text to struct(lang_pred, score, bits_per_byte)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def predict(texts: pa.Array) -> pa.Array:
        trees = shared.value
        offsets, body = utf8_parts(texts)
        bits, sizes = trees.code_lengths(offsets, body), np.maximum(np.diff(offsets), 1)
        known = has_letters(offsets, body) & bool(trees.languages)
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        scale = np.minimum(1.0, SCORE_BYTES / sizes)
        score = 1.0 / np.exp2(-(bits - low[:, None]) * scale[:, None]).sum(1)
        names = np.array([*trees.languages, "und"], dtype=object)[np.where(known, best, len(trees.languages))]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(low / sizes)], fields=list(kind))

    return predict


def predict_language(docs: DataFrame, model: ContextTrees, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits_per_byte, from the whole text alone.

    Null texts, empty texts and texts without a letter are `und` with score 0, as are all texts if nothing could be
    learned. Ties go to the first language by code point. Input columns of the same names are replaced; other extra
    columns stay; repeated rows each get their result; an empty table stays empty.
    """
    column = language_udf(docs.sparkSession, model)(F.col("text"))
    names = {prefix + k for k in ("lang_pred", "score", "bits_per_byte")}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    scored = docs.select(*kept, column.alias("__language"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"__language.{k}").alias(prefix + k) for k in ("lang_pred", "score", "bits_per_byte")])


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs)
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """The documents in a language that is recognised, with the predicted one in lang where that is null.

    A document is rejected if its text is null or has no letter, or if no learned language codes it in less than the
    RAW_BITS a byte that it takes as it is. Where no language could be learned, all documents with a letter stay.
    Columns keep their names, types and order, whatever they are called; repeated rows each stay or go; an empty table
    stays empty.
    """
    model = fit_language_model(docs)
    name, own = free_name(docs, "__language"), [F.col(f"`{c}`") for c in docs.columns]
    if not model.languages:
        small_batches(docs.sparkSession)
        return docs.select(*own, _with_letters("text").alias(name)).filter(F.col(name)).select(*own)
    # a filter on a deterministic function's result would be pushed below it, and the function called twice
    found = docs.select(*own, language_udf(docs.sparkSession, model).asNondeterministic()(F.col("text")).alias(name))
    kept = found.filter((F.col(name)["lang_pred"] != "und") & (F.col(name)["bits_per_byte"] < RAW_BITS))
    return kept.select(*[(F.coalesce("lang", F.col(name)["lang_pred"]).alias(c) if c == "lang" else F.col(f"`{c}`")) for c in docs.columns])


def accuracy(predicted: pd.DataFrame) -> float:
    """Share of rows whose lang_pred is their lang."""
    return float((predicted["lang_pred"] == predicted["lang"]).mean())
