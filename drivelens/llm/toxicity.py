"""Toxicity by two class-conditional Kneser-Ney bigram models.

A text's evidence is the difference of its log-likelihoods under the toxic and the ordinary model, per word. Both
models back off from bigrams to their class's words and from there to counts that the classes share, so that an
expression that is rare in one class is smoothed by what both have seen. How far a first word may move its follower's
ratio, and up to which margin a ratio counts as chance, are fitted on held-out labels.

Counts are gathered from all labelled training texts, without any limit. Of absolutely discounted counts, those up to
the discount are exactly the back-off: words, contexts and bigrams without any count above it need no row of their own
in the model, and nothing else is left out. The model is a table that grows with the texts. It is sent to all tasks
while it is small, and joined to the texts' bigrams where it is not, with the same result.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, id_remainder, mix64, small_batches, spans_of_bytes, utf8_parts, word_hashes

#: What is taken off each count of the smaller class; the larger class's discount is larger as its counts are.
DISCOUNT = 2.0
#: The same for bigrams: copies of a text repeat its bigrams, which says little about their class.
BIGRAM_DISCOUNT = 8.0
#: What is tried on held-out labels: by how much a first word moves its follower's ratio at most, lest a copied passage
#: outweigh what it says, and the margin up to which ratios, as chance and the classes' subjects make them, count as none.
SHIFTS = (0.5, math.inf)
MARGINS = (0.0, 0.5, 1.0)
SETTINGS = tuple(itertools.product(SHIFTS, MARGINS))
#: Words without evidence that are added to every text, so that one rare word of a very short text decides little.
PRIOR_WORDS = 10
#: Of a hundred training texts, those that calibrate the score instead of being counted.
CALIBRATION = 25
#: The calibration reads a histogram of the evidence with so many bins, not the texts' own values.
BINS = 2000
REACH = 0.5
THRESHOLD = 0.7
#: Labels, of a dozen bytes each, that are sent to all tasks at most.
BROADCAST_LABELS = 2_000_000
#: Rows of the model, of 16 bytes each, that are sent to all tasks at most.
BROADCAST_ROWS = 4_000_000
#: Words that a counting task gathers before it passes their counts on.
BUFFER = 1 << 21
#: Parts that a context's bigrams are dealt out in: a frequent word is followed by very many.
PARTS = 4
#: The context of a text's first word.
START = -1
_SLICE = 1 << 21
_C = np.uint64(0x9E3779B97F4A7C15)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """63 bits of a word's hash, as a number that sorts alike signed or not."""
    return (hashes >> np.uint64(1)).astype(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return word_keys(mix64(mix64(first.astype(np.uint64) + _C) + second.astype(np.uint64)))


def _bigrams(offsets: np.ndarray, body: np.ndarray):
    """(first text, words of each text, first keys, second keys) of slices of texts."""
    for a, b in spans_of_bytes(offsets, _SLICE):
        hashes, counts = word_hashes(offsets[a : b + 1] - offsets[a], body[offsets[a] : offsets[b]])
        second = word_keys(hashes)
        first = np.concatenate([np.full(1, START), second[:-1]])[: len(second)]
        first[(np.cumsum(counts) - counts)[counts > 0]] = START
        yield a, counts, first, second


@dataclass
class Lookup:
    """Sorted keys and their values; `other` is the value of every other key."""

    keys: np.ndarray
    values: np.ndarray
    other: float = 0.0

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, other: float = 0.0) -> Lookup:
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], values[order], other)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the keys are known."""
        if not len(self.keys):
            return np.full(len(keys), self.other), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.values[at], self.other), known


def ratios(gain: np.ndarray, context: np.ndarray, pair: np.ndarray, known: np.ndarray, shift: float, margin: float) -> np.ndarray:
    """Of each word, the log-likelihood ratio after its first word, moved by `shift` at most, as far as it exceeds the margin."""
    total = gain + np.clip(np.where(known, pair - gain, context), -shift, shift)
    return np.sign(total) * np.maximum(np.abs(total) - margin, 0)


@dataclass
class KneserNey:
    """words (key, gain), contexts (key, value) and grams (first, second, value): log-likelihood ratios, toxic over
    ordinary, of words, of contexts' back-off and of bigrams; base is that of every other word. small: the same as
    arrays, None where they are too large to be sent to all tasks. shift and margin are one of SETTINGS."""

    words: DataFrame | None = None
    contexts: DataFrame | None = None
    grams: DataFrame | None = None
    base: float = 0.0
    small: tuple[Lookup, Lookup, Lookup] | None = None
    shift: float = SHIFTS[0]
    margin: float = MARGINS[-1]
    slope: float = 0.0
    level: float = -1e3
    sizes: dict = field(default_factory=dict)


def _evidence_of(small: tuple[Lookup, Lookup, Lookup], settings, offsets: np.ndarray, body: np.ndarray) -> np.ndarray:
    """(texts, settings): each text's summed ratios by its words and the prior ones; 0 without words."""
    words, contexts, grams = small
    out = np.zeros((len(offsets) - 1, len(settings)))
    for a, counts, first, second in _bigrams(offsets, body):
        if not len(second):
            continue
        gain, context = words(second)[0], contexts(first)[0]
        pair, known = grams(pair_keys(first, second))
        text = np.repeat(np.arange(len(counts)), counts)
        for k, (shift, margin) in enumerate(settings):
            out[a : a + len(counts), k] = np.bincount(text, ratios(gain, context, pair, known, shift, margin), len(counts)) / (counts + PRIOR_WORDS)
    return out


def _counted(batches):
    """(first, second, fold, n) of the bigrams of all texts, summed over what a task has gathered."""
    held: dict[int, list] = {}
    size = 0

    def passed():
        for fold, parts in held.items():
            first, second = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, at, n = np.unique(pair_keys(first, second), return_index=True, return_counts=True)
            # a context's bigrams follow one another, which packs them well
            order = np.lexsort((second[at] % PARTS, first[at]))
            at, n = at[order], n[order]
            yield pa.RecordBatch.from_arrays([pa.array(first[at]), pa.array(second[at]), pa.array(np.full(len(at), fold, np.int32)), pa.array(n.astype(np.int64))], ["first", "second", "fold", "n"])

    for batch in batches:
        folds = batch.column("fold").to_numpy(zero_copy_only=False)
        for a, counts, first, second in _bigrams(*utf8_parts(batch.column("text"))):
            fold = np.repeat(folds[a : a + len(counts)], counts)
            for f in np.unique(fold):
                held.setdefault(int(f), []).append((first[fold == f], second[fold == f]))
            size += len(second)
            if size >= BUFFER:
                yield from passed()
                held, size = {}, 0
    yield from passed()


def fit_model(labelled: DataFrame) -> KneserNey:
    """Models of labelled texts (doc_id, text, toxic 0/1). Without a text of either class every score is 0."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.filter(F.col("text").isNotNull() & F.col("toxic").isNotNull()).select("text", "doc_id", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id"), F.lit(100)) < CALIBRATION).alias("held"))
    sizes = {r["toxic"]: r["count"] for r in rows.filter("not held").groupBy("toxic").count().collect()}
    # the number of a word's contexts grows more slowly than the texts: each class counts them in folds about as large
    # as the smaller class, so that a word that is as frequent in both has as many a fold in both
    least = max(1, min(sizes.get(0, 0), sizes.get(1, 0)))
    folds = [max(1, min(1 << 12, round(sizes.get(c, 0) / least))) for c in (0, 1)]
    number = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.when(F.col("toxic") == 1, folds[1]).otherwise(folds[0])).cast("int")
    counted = rows.filter("not held").select("text", (number * 2 + F.col("toxic")).alias("fold"))
    is_toxic = F.col("fold") % 2 == 1
    by_class = [agg for c, x in ((is_toxic, "t"), (~is_toxic, "o")) for agg in (F.sum(F.when(c, F.col("n")).otherwise(0)).alias(x), F.sum(F.when(c, 1).otherwise(0)).alias(f"k{x}"))]
    # tasks have summed what they saw: dealt out by context once, counts are summed by fold and then by class in place
    dealt = counted.mapInArrow(_counted, "first long, second long, fold int, n long").withColumn("part", F.col("second") % PARTS)
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "first", "part")
    pairs = dealt.groupBy("first", "part", "second", "fold").agg(F.sum("n").alias("n")).groupBy("first", "part", "second").agg(*by_class).drop("part").persist(StorageLevel.DISK_ONLY)
    model = _estimate(pairs)
    pairs.unpersist()
    if model.words is not None:
        _calibrate(model, rows.filter("held"))
    return model


def _estimate(pairs: DataFrame) -> KneserNey:
    """pairs: first, second, t and o (counts in toxic and ordinary texts), kt and ko (folds of each class that have it)."""
    # a word's continuations: in how many contexts of its folds each class has it
    seconds = cut(pairs.groupBy("second").agg(F.sum("kt").alias("kt"), F.sum("ko").alias("ko")))
    total = seconds.agg(F.sum("kt").alias("t"), F.sum("ko").alias("o"), F.count("*").alias("n")).first()
    if not total["t"] or not total["o"]:
        return KneserNey()
    scale = {c: total[c] / min(total["t"], total["o"]) for c in "to"}
    spent = seconds.agg(*[F.sum(F.least(F.col(f"k{c}").cast("double"), F.lit(DISCOUNT * scale[c]))).alias(c) for c in "to"]).first()
    # the mass that a class's words leave to the shared counts
    back = {c: spent[c] / total[c] for c in "to"}
    shared = (F.col("kt") + F.col("ko") + 1) / F.lit(float(total["t"] + total["o"] + total["n"] + 1))
    over = lambda c, d: F.greatest(F.col(c) - F.lit(d), F.lit(0.0))
    low = {c: over(f"k{c}", DISCOUNT * scale[c]) / F.lit(float(total[c])) + F.lit(back[c]) * shared for c in "to"}
    told = seconds.filter((F.col("kt") > DISCOUNT * scale["t"]) | (F.col("ko") > DISCOUNT * scale["o"]))
    words = told.select(F.col("second").alias("key"), F.log(low["t"] / low["o"]).alias("gain"))
    own = {c: over(c, BIGRAM_DISCOUNT * scale[c]) for c in "to"}
    firsts = pairs.groupBy("first").agg(*[F.sum(c).alias(f"n{c}") for c in "to"], *[F.sum(own[c]).alias(f"s{c}") for c in "to"]).filter("st > 0 or so > 0")
    # what the bigrams leave of a context's mass goes to its back-off
    left = {c: F.greatest(1 - F.col(f"s{c}") / F.greatest(F.col(f"n{c}"), F.lit(1)), F.lit(1e-3)) for c in "to"}
    firsts = cut(firsts.select("first", "nt", "no", left["t"].alias("lt"), left["o"].alias("lo")))
    contexts = firsts.select(F.col("first").alias("key"), F.log(F.col("lt") / F.col("lo")).alias("value"))
    kept = pairs.filter((F.col("t") > BIGRAM_DISCOUNT * scale["t"]) | (F.col("o") > BIGRAM_DISCOUNT * scale["o"])).select("first", "second", "t", "o")
    value = {c: own[c] / F.greatest(F.col(f"n{c}"), F.lit(1)) + F.col(f"l{c}") * F.col(f"low{c}") for c in "to"}
    lows = seconds.select("second", low["t"].alias("lowt"), low["o"].alias("lowo"))
    grams = kept.join(firsts, "first").join(lows, "second").select("first", "second", F.log(value["t"] / value["o"]).alias("value"))
    words, grams = cut(words), cut(grams)
    sizes = {"words": words.count(), "contexts": contexts.count(), "grams": grams.count()}
    base = math.log(back["t"] / back["o"]) if back["t"] and back["o"] else 0.0
    model = KneserNey(words, contexts, grams, base, sizes=sizes)
    if sum(sizes.values()) <= BROADCAST_ROWS:
        w, c, g = words.toPandas(), contexts.toPandas(), grams.toPandas()
        array = lambda x, kind: x.to_numpy(kind)
        model.small = (
            Lookup.of(array(w["key"], np.int64), array(w["gain"], float), base), Lookup.of(array(c["key"], np.int64), array(c["value"], float)),
            Lookup.of(pair_keys(array(g["first"], np.int64), array(g["second"], np.int64)), array(g["value"], float)),
        )
    return model


_BIGRAM = T.StructType([T.StructField("first", T.LongType()), T.StructField("second", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.LongType())])


@F.arrow_udf(T.ArrayType(_BIGRAM))
def _text_bigrams(texts: pa.Array) -> pa.Array:
    """The different bigrams of each text, how often it has them and how many words it has."""
    out: list[list] = [[] for _ in range(len(texts))]
    for a, counts, first, second in _bigrams(*utf8_parts(texts)):
        ends = np.cumsum(counts)
        for i, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
            if e > b:
                _, at, n = np.unique(pair_keys(first[b:e], second[b:e]), return_index=True, return_counts=True)
                out[a + i] = [{"first": int(first[b + j]), "second": int(second[b + j]), "n": int(m), "words": int(e - b)} for j, m in zip(at, n, strict=True)]
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("second", pa.int64()), ("n", pa.int32()), ("words", pa.int64())])))


def _with_evidence(docs: DataFrame, model: KneserNey, settings) -> DataFrame:
    """docs (with a column text) and `__e`: array of each text's evidence under the settings."""
    if model.small is not None:
        shared = docs.sparkSession.sparkContext.broadcast((model.small, settings))

        @F.arrow_udf("array<double>")
        def evidence(texts: pa.Array) -> pa.Array:
            found = _evidence_of(*shared.value, *utf8_parts(texts))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(settings)), pa.int32()), pa.array(found.ravel()))

        return docs.select("*", evidence("text").alias("__e"))
    # a text's evidence depends on the text alone: equal texts are looked up once
    keyed = docs.withColumn("__key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = keyed.select("__key", "text").dropDuplicates(["__key"])
    asked = texts.select("__key", F.explode(_text_bigrams("text")).alias("b")).select("__key", "b.*")
    # bigrams are looked up once each, however many texts have them
    known = asked.select("first", "second").distinct().join(model.words.withColumnRenamed("key", "second"), "second", "left").join(model.contexts.select(F.col("key").alias("first"), F.col("value").alias("context")), "first", "left")
    known = known.join(model.grams, ["first", "second"], "left").fillna({"gain": model.base, "context": 0.0})
    moved = F.coalesce(F.col("value") - F.col("gain"), F.col("context"))

    def ratio(shift: float, margin: float) -> Column:
        total = F.col("gain") + (moved if math.isinf(shift) else F.greatest(F.lit(-shift), F.least(F.lit(shift), moved)))
        return F.signum(total) * F.greatest(F.abs(total) - margin, F.lit(0.0))

    valued = asked.join(known.select("first", "second", F.array(*[ratio(*s) for s in settings]).alias("r")), ["first", "second"])
    sums = [F.sum(F.col("r")[k] * F.col("n")) / (F.first("words") + PRIOR_WORDS) for k in range(len(settings))]
    found = valued.groupBy("__key").agg(F.array(*sums).alias("__e"))
    none = F.array(*[F.lit(0.0)] * len(settings))
    return keyed.join(found, "__key", "left").withColumn("__e", F.coalesce("__e", none)).drop("__key")


def _calibrate(model: KneserNey, held: DataFrame) -> None:
    """Choose the setting, and fit slope and level of the logistic score, on a histogram of the held texts' evidence."""
    spot = F.floor((F.least(F.greatest("e", F.lit(-REACH)), F.lit(REACH)) + REACH) * (BINS / 2 / REACH)).cast("int")
    scored = _with_evidence(held.select("toxic", "text"), model, SETTINGS).select("toxic", F.posexplode("__e").alias("k", "e"))
    rows = scored.groupBy("k", spot.alias("bin"), "toxic").count().collect()
    best = math.inf
    model.slope, model.level = 50.0, -5.0
    for k, (shift, margin) in enumerate(SETTINGS):
        part = sorted((r["bin"], r["toxic"], r["count"]) for r in rows if r["k"] == k)
        x, y, w = (np.array(c, float) for c in zip(*part, strict=True)) if part else (np.zeros(0),) * 3
        if len(set(y)) < 2:
            return
        slope, level, loss = _logistic((x + 0.5) * 2 * REACH / BINS - REACH, y, w)
        if loss < best:
            best, model.slope, model.level, model.shift, model.margin = loss, slope, level, shift, margin


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and loss of a logistic fit by Newton's method, slightly regularised; both classes weigh alike."""
    centre = (np.average(x, weights=w * (y == 0)) + np.average(x, weights=w * (y == 1))) / 2
    scale = max(1e-3, float(np.sqrt(np.average((x - centre) ** 2, weights=w))))
    z = np.column_stack([(x - centre) / scale, np.ones_like(x)])
    # so that 0.7 does not depend on how rare toxic texts are
    w = np.where(y == 1, w / w[y == 1].sum(), w / w[y == 0].sum()) * min(w[y == 1].sum(), w[y == 0].sum())
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + 0.01 * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    power = np.clip(z @ beta, -30, 30)
    loss = float((w * (np.log1p(np.exp(-np.abs(power))) + np.where((power > 0) == (y == 1), 0, np.abs(power)))).sum() / w.sum())
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale), loss


def score_toxicity(docs: DataFrame, model: KneserNey) -> DataFrame:
    """docs with evidence, score (0 to 1) and predicted (1 from 0.7) of the whole text.

    Null and empty texts have no evidence and the score of evidence 0. Input columns of the same names are replaced,
    other extra columns stay; repeated rows each get their result; an empty table stays empty. Nothing is shuffled
    unless the model is too large to be sent to all tasks.
    """
    small_batches(docs.sparkSession)
    names = ["evidence", "score", "predicted"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    if model.words is None:
        found = docs.select(*own, F.lit(0.0).alias("evidence"))
    else:
        found = _with_evidence(docs.select(*own), model, [(model.shift, model.margin)]).select(*own, F.col("__e")[0].alias("evidence"))
    power = F.least(F.greatest(F.col("evidence") * model.slope + model.level, F.lit(-500.0)), F.lit(500.0))
    scored = found.select(*own, "evidence", (1 / (1 + F.exp(-power))).alias("score"))
    return scored.select(*own, "evidence", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of labelled documents whose crc32(doc_id as text) modulo 3 is not 1; an id's label is its largest.

    Up to BROADCAST_LABELS labels go to the texts; more are joined by a shuffle of both.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return docs.select("doc_id", "text").join(marks, "doc_id")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_model(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")
