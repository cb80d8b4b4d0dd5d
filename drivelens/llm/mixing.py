"""Mixing sources to target weights by entropy balancing.

Of all document rates r with sum(size * r) equal to each source's target, the one of least relative entropy to the
unmixed corpus, words as its measure, is an exponential tilt of the source's multiplier: r = exp(multiplier). The dual
is convex and separates by source once words are pre-aggregated, so its Newton iterations run side by side for all
sources in one expression. Rates are then rounded into copies: classes of like size get whole numbers of copies, with
what they miss carried on to the next smaller class, and deal them out evenly along their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

MOST = 3
NEWTON_STEPS = 64
TOLERANCE = 1e-13
#: Rows that a salt of a source and size class holds about, and the fewest salts.
SALT_ROWS = 1_000_000
SALTS = 32


def size_of(text: str = "text") -> Column:
    """Words of a text: maximal runs of characters other than space, tab and line ends.

    Split at the white space: counting matches would copy the whole text for each of them.
    """
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _weights(sources: DataFrame) -> DataFrame:
    """sources with weight: 1, 2, 3, repeating, by code point with null last.

    Sources are range-partitioned and numbered within their partitions; how many lie before a partition is summed over
    one number each, so that no task gets more sources than its range.
    """
    order = [F.col("source").isNull(), "source"]
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(sources.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    starts = sizes.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(starts, "part").withColumn("weight", (F.col("before") + F.col("line") - F.col("first")) % 3 + 1).drop("part", "line", "first", "before")


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating, by code point with null last; no target above 3 times the size.

    sources: source, source_size (one row each). The excess of capped targets is reshared by weight until none is
    above: each round is one aggregate over the sources, and the level it gives never falls, so that a source once
    capped stays so and the rounds end.
    """
    w = cut(_weights(sources))
    room = MOST * F.col("source_size") / F.col("weight")
    capped, level = F.lit(False), None
    while True:
        sums = w.agg(F.sum("source_size").alias("words"), F.sum(F.when(capped, F.col("source_size"))).alias("spent"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count("*").alias("n")).first()
        if not sums["open"]:
            level = None
            break
        new = (sums["words"] - MOST * (sums["spent"] or 0)) / sums["open"]
        if level is not None and new <= level:
            break
        level = new
        capped = room < F.lit(float(level))
    ceiling = MOST * F.col("source_size").cast("double")
    return w.select("source", "source_size", (ceiling if level is None else F.least(ceiling, F.col("weight") * F.lit(float(level)))).alias("target"))


def multiplier(size: Column, target: Column) -> Column:
    """Newton's minimiser of the dual size * exp(x) - target * x, from 0; steps below the tolerance stop."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("step"))

    def newton(state, _):
        move = target / (size * F.exp(state["x"])) - 1.0
        return F.when(F.abs(state["step"]) < TOLERANCE, state).otherwise(F.struct((state["x"] + move).alias("x"), move.alias("step")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, newton)["x"]


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row of docs (doc_id, text, source).

    copies is the rate of the source rounded down or up, 0 to 3; null and empty texts have size 0 and take no words,
    but are copied at their source's rate all the same. Sources without words have target 0 and rate 1. Repeated rows
    are rows of their own; which of equal rows gets a copy makes no difference to the result. An empty table gives no
    rows; columns other than the three are not read.
    """
    return _copies(docs.select("doc_id", "source", size_of().alias("size"))).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _class_copies(rate, classes):
    """Copies of each size class, the largest first: array<struct(class, n, copies)>.

    A class gets the whole number of copies nearest to its words at the rate and to what the classes before it left
    over or took too much, so that the copies of small texts make up for those of large ones.
    """
    begin = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:int,n:bigint,copies:bigint>>").alias("done"))

    def step(state, c):
        mean = c["words"] / c["n"]
        want = rate * c["words"] + state["carry"]
        exact = F.when(c["words"] > 0, want / F.greatest(mean, F.lit(1e-9))).otherwise(rate * c["n"])
        copies = F.least(F.greatest(F.rint(exact), F.floor(rate) * c["n"]), F.ceil(rate) * c["n"]).cast("long")
        return F.struct((want - copies * mean).alias("carry"), F.concat(state["done"], F.array(F.struct(c["class"].alias("class"), c["n"].alias("n"), copies.alias("copies")))).alias("done"))

    return F.aggregate(classes, begin, step)["done"]


def _copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size and more) with source_size, target and copies. rows are written once, without texts."""
    # size class: eight to each doubling
    by = cut(rows.withColumn("__class", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")))
    counts = by.groupBy("source", "__class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    # a source has a few hundred classes, whatever its rows
    listed = F.sort_array(F.collect_list(F.struct(F.col("__class").alias("class"), "n", "words")), asc=False)
    sources = cut(counts.groupBy("source").agg(F.sum("words").alias("source_size"), listed.alias("classes")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.exp(multiplier(F.col("source_size").cast("double"), F.col("target"))))).otherwise(F.lit(1.0))
    # rates that differ by the last bits of a number give the same copies
    rates = source_targets(sources.select("source", "source_size")).withColumn("rate", F.round(rate, 9))
    rates = rates.join(sources.select(F.col("source").alias("__s"), "classes"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    planned = rates.select(F.col("source").alias("__s"), "source_size", "target", F.explode(_class_copies(F.col("rate"), F.col("classes"))).alias("c"))
    planned = planned.select("__s", "source_size", "target", F.col("c.class").alias("__c"), F.col("c.n").alias("__n"), F.col("c.copies").alias("__k"))
    joined = by.join(planned, by["source"].eqNullSafe(planned["__s"]) & (by["__class"] == planned["__c"])).drop("__s", "__c")
    salted = joined.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(SALTS), F.ceil(F.col("__n") / SALT_ROWS))))
    cells = salted.groupBy("source", "__class", "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "__class").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("source").alias("__s"), F.col("__class").alias("__c"), F.col("__salt").alias("__t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("source", "__class", "__salt").orderBy("size", "doc_id")))
    placed = ranked.join(starts, ranked["source"].eqNullSafe(starts["__s"]) & (ranked["__class"] == starts["__c"]) & (ranked["__salt"] == starts["__t"]))
    placed = placed.withColumn("__upto", F.col("__before") + F.col("__rank"))
    copies = F.expr("__upto * __k div __n - (__upto - 1) * __k div __n")
    return placed.withColumn("copies", copies).drop("__class", "__salt", "__before", "__rank", "__upto", "__s", "__c", "__t", "__n", "__k")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Columns keep their names, types and order, whatever they are called. Rows without text or words are copied at
    their source's rate; null sources are a source. Rows that are equal in id, source and text share the copies that
    they get together, dealt out in turn. An empty table stays empty.
    """
    key = [F.xxhash64("doc_id", "source", "text").alias("key"), F.hash("text", "source", "doc_id").alias("hash")]
    # only ids and sizes are shuffled to rank the rows; the copies come back to the texts by their keys
    counts = _copies(docs.select("doc_id", "source", size_of().alias("size"), *key))
    counts = counts.groupBy("key", "hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key).join(counts, ["key", "hash"])
    turn = F.row_number().over(Window.partitionBy("key", "hash").orderBy("rows"))
    extra = F.when(turn <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    share = joined.withColumn("n", (F.expr("copies div rows") + extra).cast("int")).filter("n > 0")
    return share.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
