"""Runs, spans and intervals: gaps and islands, overlaps, one-to-one matches and look-ups by time.

Times are integers of any one unit. Interval tables have the key columns, `start`, `end` and `label`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas


def number_segments(rows: DataFrame, keys: Sequence[str], time: str, step: int, tie: Sequence[str] = (), name: str = "seg") -> DataFrame:
    """Number the stretches of each key that no gap of more than one and a half steps interrupts, from 0 [WN-13]."""
    order = Window.partitionBy(*keys).orderBy(time, *tie)
    gap = 2 * (F.col(time) - F.lag(time).over(order)) > 3 * step
    return rows.withColumn(name, F.sum(gap.cast("int")).over(order).cast("long")).fillna(0, [name])


def number_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str | Column, name: str = "run") -> DataFrame:
    """Number the maximal stretches of equal labels of each key, from 0. Null is a label like any other."""
    by = Window.partitionBy(*keys).orderBy(*order)
    label = F.col(label) if isinstance(label, str) else label
    flagged = rows.withColumn("__label", label).withColumn("__row", F.row_number().over(by))
    change = (~F.col("__label").eqNullSafe(F.lag("__label").over(by))) & (F.col("__row") > 1)
    return flagged.withColumn(name, F.sum(change.cast("long")).over(by)).drop("__label", "__row")


def as_runs(rows: DataFrame, keys: Sequence[str], time: str, label: str, tie: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """keys, run, label, first and last time and the number of rows of each run, and `extra` aggregates."""
    numbered = number_runs(rows, keys, [time, *tie], label)
    return numbered.groupBy(*keys, "run", F.col(label).alias("label")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), *extra)


def merge_touching(spans: DataFrame, keys: Sequence[str], slack: int = 0, drop: str | None = schemas.KEEP) -> DataFrame:
    """Join spans of one label that touch; what is labelled `drop` is left out afterwards, so it still separates [AG-02]."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    touches = F.lag("label").over(by).eqNullSafe(F.col("label")) & (F.col("start") - F.lag("end").over(by) <= slack)
    flagged = spans.withColumn("__new", F.when(touches, 0).otherwise(1))
    merged = flagged.withColumn("island", F.sum("__new").over(by)).groupBy(*keys, "island", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return (merged.filter(~F.col("label").eqNullSafe(drop)) if drop is not None else merged).drop("island")


def _bucketed(spans: DataFrame, width: int) -> DataFrame:
    first, last = F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")
    return spans.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], least: int, width: int) -> DataFrame:
    """Pairs of spans of the same keys that share at least `least`; columns of right get an r_ [JN-14].

    Spans meet in time buckets of `width`, which makes the range join an equi-join; a pair counts in the bucket where
    its overlap begins.
    """
    named = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in right.columns])
    a = _bucketed(left, width)
    b = _bucketed(named.withColumnsRenamed({"r_start": "start", "r_end": "end"}), width).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    begin, finish = F.greatest("start", "r_start"), F.least("end", "r_end")
    joined = a.join(b, [*keys, "bucket"]).withColumn("overlap", finish - begin)
    return joined.filter((F.col("overlap") >= least) & (F.floor(begin / width) == F.col("bucket"))).drop("bucket")


def greedy_match(pairs: DataFrame, keys: Sequence[str], left: str = "i", right: str = "j") -> DataFrame:
    """One-to-one pairs, the largest overlap first and of equals the larger indexes [TK-04]. keys: session and label, for pairs share a label.

    Each pair depends on those before it, so they stream in that order through their key's task, many keys to a call.
    """
    names = [*keys, left, right]

    def match(batches):
        key, seen_left, seen_right = None, set(), set()
        for rows in batches:
            keep = []
            for *own, i, j in zip(*(rows[c].tolist() for c in names), strict=True):
                if own != key:
                    key, seen_left, seen_right = own, set(), set()
                free = i not in seen_left and j not in seen_right
                keep.append(free)
                if free:
                    seen_left.add(i)
                    seen_right.add(j)
            yield rows[keep]

    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, F.desc("overlap"), F.desc(left), F.desc(right))
    return ordered.mapInPandas(match, pairs.schema)


def label_at(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, name: str = "label_at", missing: str | None = None) -> DataFrame:
    """points with the label of the span that holds their time, start included and end not [JN-15]. Spans of a key don't overlap."""
    from .asof import asof_backward

    found = asof_backward(points, spans.select(*keys, F.col("start").alias("__t"), F.col("end").alias("__end"), F.col("label").alias(name)), keys, time, "__t", ["__end", name])
    held = F.when(F.col(time) < F.col("__end"), F.col(name))
    return found.withColumn(name, F.coalesce(held, F.lit(missing)) if missing is not None else held).drop("__end")


def near_points(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, reach: int, width: int) -> DataFrame:
    """(point columns, span columns) of spans that come within `reach` of a point, ends included [JN-16]."""
    moments = points.withColumn("start", F.col(time) - reach).withColumn("end", F.col(time) + reach)
    moments = _bucketed(moments, width).withColumnsRenamed({"start": "__a", "end": "__b"})
    joined = moments.join(_bucketed(spans, width), [*keys, "bucket"]).filter((F.col("start") <= F.col("__b")) & (F.col("end") >= F.col("__a")))
    # a pair counts in the first bucket that both are in
    first = F.floor(F.greatest("start", "__a") / width)
    return joined.filter(first == F.col("bucket")).drop("bucket", "__a", "__b")


def any_near(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, reach: int, name: str) -> DataFrame:
    """points with whether any span of the same keys comes within `reach`, ends included [JN-16]. Spans may overlap.

    Of the spans that start in time, the one that ends last decides. Both sides are one ordered stream for each key,
    so that the rows stay as many as they are, whatever the spans' lengths.
    """
    own = [c for c in points.columns if c not in keys]
    p = points.select(*keys, (F.col(time) + reach).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__end"), F.struct(*own).alias("__p"))
    s = spans.filter("start is not null").select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__side"), F.col("end").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = p.unionByName(s, allowMissingColumns=True).withColumn("__last", F.max("__end").over(before)).filter("__side = 1")
    near = F.coalesce(F.col("__last") >= F.col(f"__p.{time}") - reach, F.lit(False))
    return found.select(*keys, *[F.col(f"__p.{c}").alias(c) for c in own], near.alias(name))


def covered(spans: DataFrame, keys: Sequence[str], session: DataFrame) -> DataFrame:
    """keys and `ok`: whether spans cover session (keys, session_start, session_end) without gap, overlap or excess [VD-03]."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    checked = spans.withColumn("__joined", F.coalesce(F.lag("end").over(by) == F.col("start"), F.lit(True)) & (F.col("start") < F.col("end")))
    whole = checked.groupBy(*keys).agg(F.min("start").alias("__a"), F.max("end").alias("__b"), F.bool_and("__joined").alias("__j"))
    ok = F.coalesce((F.col("__a") == F.col("session_start")) & (F.col("__b") == F.col("session_end")) & F.col("__j"), F.lit(False))
    return session.join(whole, list(keys), "left").select(*keys, ok.alias("ok"))


def change_segments(states: DataFrame, keys: Sequence[str], time: str, state: str, wanted: Sequence, tie: Sequence[str] = ()) -> DataFrame:
    """Periods of wanted states: from a change to the next one, the last until the key's last report [AG-24]."""
    changed = as_runs(states, keys, time, state, tie)
    by = Window.partitionBy(*keys).orderBy("run")
    last = Window.partitionBy(*keys)
    ended = changed.withColumn("end", F.coalesce(F.lead("first").over(by), F.max("last").over(last)))
    return ended.filter(F.col("label").isin(*wanted)).select(*keys, F.col("first").alias("start"), "end", F.col("label").alias("code"))


def keep_apart(rows: DataFrame, keys: Sequence[str], time: str, gap: int, strict: bool = True) -> DataFrame:
    """Times more than `gap` after the last one that was kept (or, not strict, at least that) [AG-10, WN-20].

    The comparison is with the last kept time, not the last time: each key's times stream in order through its task,
    many keys to a call, and all that is held is the last one kept.
    """
    names = [*keys, time]
    least = gap + 1 if strict else gap

    def keep(batches):
        key, last = None, None
        for part in batches:
            kept = []
            for *own, t in zip(*(part[c].tolist() for c in names), strict=True):
                if own != key or t - last >= least:
                    key, last = own, t
                    kept.append(True)
                else:
                    kept.append(False)
            yield part[kept]

    whole = rows.select(*keys, F.col(time).cast("long").alias(time)).filter(F.col(time).isNotNull())
    ordered = whole.repartition(*keys).sortWithinPartitions(*keys, time)
    return ordered.mapInPandas(keep, whole.schema)
