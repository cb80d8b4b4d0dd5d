"""Joins by time: the latest row before, the nearest row, and values interpolated between neighbours.

Both sides are merged into one ordered stream for each key, so that a join is one shuffle and one sort, whatever the
number of matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    payload = F.struct(F.col(right_time).cast("long").alias("__t"), *values).alias("__v")
    own = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(time).cast("long").alias("__at"), F.lit(1).alias("__side"), F.struct(*own).alias("__l"))
    r = right.select(*keys, F.col(right_time).cast("long").alias("__at"), F.lit(0).alias("__side"), payload)
    return l.unionByName(r, allowMissingColumns=True)


def _neighbours(left, right, keys, time, right_time, values) -> DataFrame:
    """left rows with __p and __n, the last right row at or before their time and the first at or after it."""
    stream = _merged(left, right, keys, time, right_time, values)
    # rows of the right side at the same time count on both sides of a left row; among themselves their values order them
    before = Window.partitionBy(*keys).orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), "__side", F.col("__v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stream.withColumn("__p", F.last("__v", ignorenulls=True).over(before)).withColumn("__n", F.last("__v", ignorenulls=True).over(after))
    return found.filter("__side = 1")


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str], max_age: int | None = None, defaults: dict | None = None) -> DataFrame:
    """left with `values` of the last right row at or before its time [JN-04]; older than max_age, or none: null or a default [JN-05]."""
    stream = _merged(left, right, keys, time, right_time, values)
    before = Window.partitionBy(*keys).orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stream.withColumn("__p", F.last("__v", ignorenulls=True).over(before)).filter("__side = 1")
    fresh = F.lit(True) if max_age is None else F.col("__at") - F.col("__p.__t") <= max_age
    own = [c for c in left.columns if c not in keys]
    value = lambda c: F.coalesce(F.when(fresh, F.col(f"__p.{c}")), F.lit((defaults or {}).get(c)))
    return found.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in own], *[value(c).alias(c) for c in values])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str], tolerance: int) -> DataFrame:
    """left with `values` and `distance` of the right row nearest in time, the earlier of equals; null beyond the tolerance [JN-06, JN-07]."""
    found = _neighbours(left, right, keys, time, right_time, values)
    back, ahead = F.col("__at") - F.col("__p.__t"), F.col("__n.__t") - F.col("__at")
    take_back = F.col("__p").isNotNull() & (F.col("__n").isNull() | (back <= ahead))
    picked = F.when(take_back, F.col("__p")).otherwise(F.col("__n"))
    distance = F.when(take_back, back).otherwise(ahead)
    own = [c for c in left.columns if c not in keys]
    ok = F.col("__distance") <= tolerance
    chosen = found.withColumn("__pick", picked).withColumn("__distance", distance)
    return chosen.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in own], *[F.when(ok, F.col(f"__pick.{c}")).alias(c) for c in values], F.when(ok, F.col("__distance")).alias("distance"))


def interpolate(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """left with `values` interpolated between the neighbouring right rows, held at both ends, and `gap` to the nearest one [JN-08]."""
    found = _neighbours(left, right, keys, time, right_time, values)
    span = F.col("__n.__t") - F.col("__p.__t")
    part = F.when(span > 0, (F.col("__at") - F.col("__p.__t")) / span).otherwise(F.lit(0.0))

    def value(c: str) -> Column:
        a, b = F.col(f"__p.{c}"), F.col(f"__n.{c}")
        return F.when(F.col("__p").isNull(), b).when(F.col("__n").isNull(), a).otherwise(a + (b - a) * part)

    own = [c for c in left.columns if c not in keys]
    gap = F.least(F.col("__at") - F.col("__p.__t"), F.col("__n.__t") - F.col("__at"))
    bracket = F.when(F.col("__p").isNotNull() & F.col("__n").isNotNull(), span)
    return found.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in own], *[value(c).alias(c) for c in values], gap.alias("gap"), bracket.alias("bracket"))


def supported(interpolated: DataFrame, max_gap: int) -> DataFrame:
    """Rows inside the range whose nearest message and bracketing gap are at most `max_gap`; an exact hit needs no bracket [JN-09]."""
    return interpolated.filter((F.col("bracket").isNotNull()) & (F.col("gap") <= max_gap) & ((F.col("gap") == 0) | (F.col("bracket") <= max_gap)))


def clock(sessions: DataFrame, keys: Sequence[str], step: int, start: str = "start", end: str = "end") -> DataFrame:
    """Times on multiples of `step` within each session, both ends included [FLT-06]. A session too short for one has none."""
    first = F.col(start) + F.pmod(-F.col(start), F.lit(step))
    ticks = F.when(first <= F.col(end), F.sequence(first, F.col(end), F.lit(step).cast("long")))
    return sessions.select(*keys, F.explode(ticks).alias("t"))


def grid(sessions: DataFrame, keys: Sequence[str], step: int, start: str = "start", end: str = "end") -> DataFrame:
    """i and t of a regular grid from each session's first time to its last [OR-07]."""
    n = F.floor((F.col(end) - F.col(start)) / step)
    return sessions.select(*keys, F.posexplode(F.sequence(F.col(start), F.col(start) + n * step, F.lit(step).cast("long"))).alias("i", "t"))


def grid_index(time: Column, start: Column, step: int) -> Column:
    """Index of the nearest grid time, halves to even [FLT-03]."""
    return F.rint((time - start) / F.lit(float(step))).cast("long")
