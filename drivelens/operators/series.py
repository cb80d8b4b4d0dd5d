"""Signals on a grid: smoothing, derivatives, angles, events and summaries of windows.

Rows of a key are ordered by an index. All are window functions over one ordering of the key, which Spark computes in
one shuffle and sort for as many signals as share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = 3.141592653589793


def _order(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def moving_average(value: str, keys: Sequence[str], order: str, width: int) -> Column:
    """Mean of `width` values around each, the edge values repeated beyond the ends [WN-01].

    The frame is half the width before and the rest after: for even widths one value more before.
    """
    if width <= 1:
        return F.col(value)
    before, after = width // 2, width - 1 - width // 2
    w, whole = _order(keys, order), Window.partitionBy(*keys)
    frame = w.rowsBetween(-before, after)
    place, n = F.row_number().over(w), F.count("*").over(whole)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    short_left, short_right = F.greatest(F.lit(0), before - (place - 1)), F.greatest(F.lit(0), after - (n - place))
    mean = (F.sum(value).over(frame) + short_left * first + short_right * last) / F.lit(float(width))
    return F.when(n < 2, F.col(value)).otherwise(mean)


def gradient(value: str, keys: Sequence[str], order: str, step: float) -> Column:
    """Central differences inside, one-sided ones at the ends; null for a single value [WN-02]."""
    w = _order(keys, order)
    ahead, back = F.lead(value).over(w), F.lag(value).over(w)
    return F.coalesce((ahead - back) / F.lit(2.0 * step), (ahead - F.col(value)) / F.lit(step), (F.col(value) - back) / F.lit(step))


def wrap(angle: Column) -> Column:
    """An angle in [-pi, pi) [FN-02]."""
    return F.pmod(angle + PI, F.lit(2 * PI)) - PI


def unwrap(rows: DataFrame, value: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """rows with `name`: the angle without jumps of more than half a turn [WN-03]."""
    w = _order(keys, order)
    turns = F.ceil((F.col("__d") - PI) / F.lit(2 * PI))
    stepped = rows.withColumn("__d", F.col(value) - F.lag(value).over(w))
    # a step of half a turn exactly stays as it is, whichever its sign
    jump = F.when(F.abs("__d") <= PI, F.lit(0)).otherwise(turns)
    return stepped.withColumn("__k", F.coalesce(jump, F.lit(0))).withColumn(name, F.col(value) - F.lit(2 * PI) * F.sum("__k").over(w)).drop("__d", "__k")


def path_length(rows: DataFrame, x: str, y: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """rows with `name`: the length of the path up to each [WN-04]."""
    w = _order(keys, order)
    part = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return rows.withColumn("__part", F.coalesce(part, F.lit(0.0))).withColumn(name, F.sum("__part").over(w)).drop("__part")


def stop_go(rows: DataFrame, value: str, keys: Sequence[str], order: str, low: float = 0.1, high: float = 0.3) -> DataFrame:
    """rows with `moving` by hysteresis, and `event` where it changes: stop below `low`, start above `high` [WN-10].

    The state before any crossing is whether the first value is above `low`.
    """
    w = _order(keys, order)
    crossing = F.when(F.col(value) < low, F.lit(False)).when(F.col(value) > high, F.lit(True))
    seed = F.first(value).over(w) > low
    moving = F.coalesce(F.last(crossing, ignorenulls=True).over(w), seed)
    event = F.when(F.lag("moving").over(w) != F.col("moving"), F.when(F.col("moving"), "start").otherwise("stop"))
    return rows.withColumn("moving", moving).withColumn("event", event)


def changes(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], ignore: str | None = None) -> DataFrame:
    """Rows where the value differs from the row before, with `previous`; rows of the ignored value are not changes [WN-08, WN-09, FLT-08]."""
    known = rows if ignore is None else rows.filter(F.col(value) != ignore)
    w = Window.partitionBy(*keys).orderBy(*order)
    return known.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & ~F.col("previous").eqNullSafe(F.col(value)))


def onsets(rows: DataFrame, value: str, keys: Sequence[str], order: str, threshold: float = -0.3, valid: str | None = None) -> DataFrame:
    """Rows whose value falls below the threshold from a value at or above it, both valid [AG-14]."""
    w = _order(keys, order)
    ok = F.lit(True) if valid is None else F.col(valid) & F.lag(valid).over(w)
    flagged = rows.withColumn("__on", (F.lag(value).over(w) >= threshold) & (F.col(value) < threshold) & ok)
    return flagged.filter("__on").drop("__on")


def window_summary(rows: DataFrame, value: str, keys: Sequence[str], order: str, reach: int) -> DataFrame:
    """rows with summaries of the values within `reach` of their index, clipped to the key [AG-12, WN-11].

    w_from, w_to, w_change, w_min, w_min_at, w_max, w_max_at, w_n; the first of equal extremes counts.
    """
    frame = _order(keys, order).rangeBetween(-reach, reach)
    at, v = F.col(order), F.col(value)
    low = F.min(F.struct(v.alias("v"), at.alias("i"))).over(frame)
    high = F.min(F.struct((-v).alias("v"), at.alias("i"))).over(frame)
    begin, finish = F.first(v).over(frame), F.last(v).over(frame)
    return rows.select(
        "*", begin.alias("w_from"), finish.alias("w_to"), (finish - begin).alias("w_change"), low["v"].alias("w_min"), low["i"].alias("w_min_at"),
        (-high["v"]).alias("w_max"), high["i"].alias("w_max_at"), F.count("*").over(frame).alias("w_n"),
    )


def longitudinal(rows: DataFrame, keys: Sequence[str], order: str, speed: str, accel: str, reach: int, stopped: float = 0.3, change: float = 1.0, brake: float = -3.0) -> DataFrame:
    """rows with the rule label of speed: stopped, hard_braking, then the change over `reach` rows either way, held at the ends [WN-22]."""
    w = _order(keys, order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.coalesce(F.lead(speed, reach).over(w), F.last(speed).over(everything))
    back = F.coalesce(F.lag(speed, reach).over(w), F.first(speed).over(everything))
    gained = ahead - back
    label = F.when(F.col(speed) < stopped, "stopped").when(F.col(accel) < brake, "hard_braking").when(gained > change, "accelerating").when(gained < -change, "decelerating").otherwise("cruising")
    return rows.withColumn("longitudinal", label)


def inside_spans(rows: DataFrame, keys: Sequence[str], order: str, inside: Column, observed: Column, label: str | None = None) -> DataFrame:
    """Stretches of rows inside, with whether entry and exit were observed [AG-15].

    A stretch ends where rows are not observed or not inside. Its entry is observed if the row before it is and lies
    outside, likewise its exit. With a label: the most frequent one, the first seen of equals.
    """
    w = _order(keys, order)
    marked = rows.withColumn("__in", inside).withColumn("__seen", observed).withColumn("__live", F.col("__in") & F.col("__seen"))
    marked = marked.withColumn("__before", F.lag("__live").over(w)).withColumn("__prev_seen", F.lag("__seen").over(w)).withColumn("__next_seen", F.lead("__seen").over(w)).withColumn("__next", F.lead("__live").over(w))
    marked = marked.withColumn("__span", F.sum(F.when(F.col("__live") & ~F.coalesce("__before", F.lit(False)), 1).otherwise(0)).over(w))
    live = marked.filter("__live")
    entry = F.bool_or(~F.coalesce("__before", F.lit(True)) & F.coalesce("__prev_seen", F.lit(False)))
    leave = F.bool_or(~F.coalesce("__next", F.lit(True)) & F.coalesce("__next_seen", F.lit(False)))
    out = live.groupBy(*keys, "__span").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), entry.alias("entry_observed"), leave.alias("exit_observed"))
    if label is not None:
        votes = live.filter(F.col(label).isNotNull()).groupBy(*keys, "__span", label).agg(F.count("*").alias("c"), F.min(order).alias("f"))
        best = votes.groupBy(*keys, "__span").agg(F.min(F.struct((-F.col("c")).alias("c"), "f", F.col(label).alias("l")))["l"].alias("mode"))
        out = out.join(best, [*keys, "__span"], "left")
    return out.drop("__span")


def departures(rows: DataFrame, keys: Sequence[str], order: str, outside: str) -> DataFrame:
    """Stretches of a three-valued `outside` that is true; null ends a stretch and proves neither entry nor return [AG-16]."""
    w = _order(keys, order)
    marked = rows.withColumn("__o", F.col(outside)).withColumn("__p", F.lag("__o").over(w)).withColumn("__nx", F.lead("__o").over(w)).withColumn("__nt", F.lead(order).over(w))
    marked = marked.withColumn("__id", F.sum(F.when(F.col("__o") & ~F.coalesce("__p", F.lit(False)), 1).otherwise(0)).over(w))
    live = marked.filter("__o")
    returned = F.max(F.when(F.coalesce(~F.col("__nx"), F.lit(False)), F.col("__nt")))
    return live.groupBy(*keys, "__id").agg(F.min(order).alias("first"), F.max(order).alias("last_outside"), F.bool_or(F.coalesce(~F.col("__p"), F.lit(False))).alias("entry_observed"), returned.alias("returned")).drop("__id")


def timeline(ego: DataFrame, step: int, keys: Sequence[str] = ("session_id",), window: int = 25, max_gap: int = 200_000_000) -> DataFrame:
    """The regular timeline of ego messages: positions and yaw interpolated, speeds smoothed, derivatives [WN-01..03, FLT-04, JN-08].

    ego: keys, t_ns, x, y, yaw, v, yaw_rate. A grid row is valid if a message lies within max_gap.
    """
    from .asof import grid, interpolate

    keys = list(keys)
    smooth = unwrap(ego, "yaw", keys, "t_ns", "__yaw").drop("yaw").withColumnRenamed("__yaw", "yaw")
    ends = smooth.groupBy(*keys).agg(F.min("t_ns").alias("start"), F.max("t_ns").alias("end"))
    rows = interpolate(grid(ends, keys, step).withColumnRenamed("t", "t_ns"), smooth.withColumnRenamed("t_ns", "__t0"), keys, "t_ns", "__t0", ["x", "y", "yaw", "v", "yaw_rate"])
    seconds = step / 1e9
    rows = rows.withColumn("valid", F.col("gap") <= max_gap).drop("gap", "bracket")
    rows = rows.withColumn("v", moving_average("v", keys, "i", window)).withColumn("yaw_rate", moving_average("yaw_rate", keys, "i", window))
    rows = rows.withColumn("accel", gradient("v", keys, "i", seconds)).withColumn("accel", moving_average("accel", keys, "i", window))
    rows = rows.withColumn("jerk", gradient("accel", keys, "i", seconds)).withColumn("jerk", moving_average("jerk", keys, "i", 2 * window))
    return rows.select(*keys, "i", "t_ns", "valid", "x", "y", "yaw", "v", "accel", "jerk", "yaw_rate")


def lights_ahead(track: DataFrame, keys: Sequence[str], order: str, ids: str, length: str, reach: float = 150.0) -> DataFrame:
    """track with `ahead`: the lights of the next lane on the path that has any, within `reach` of path, else empty [WN-05].

    Lengths count to a millionth: what sums of floats round away doesn't decide about a light at the reach itself.
    """
    ahead = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    some = F.when(F.size(ids) > 0, F.struct(F.col(ids).alias("ids"), F.col(length).alias("s")))
    found = F.last(some, ignorenulls=True).over(ahead)
    near = F.round(found["s"] - F.col(length), 6) <= reach
    return track.withColumn("ahead", F.when(near, found["ids"]).otherwise(F.array().cast("array<bigint>")))


def resolve_lights(messages: DataFrame, track: DataFrame, keys: Sequence[str], start: str, cadence: int) -> DataFrame:
    """Each light message reduced to the light ahead [WN-06]. messages: keys, t_ns, lights (map), light_ahead; track: keys, k, ahead; start: the session's.

    A message that names the light ahead itself is used as it is; no lights ahead give none, lights without a reading unknown.
    """
    last = track.groupBy(*keys).agg(F.max("k").alias("__last"))
    placed = messages.join(last, list(keys), "left").withColumn("k", F.greatest(F.lit(0), F.least("__last", F.rint((F.col("t_ns") - F.col(start)) / F.lit(float(cadence))).cast("int"))))
    joined = placed.join(track.select(*keys, "k", "ahead"), [*keys, "k"], "left")
    read = F.element_at(F.filter(F.transform("ahead", lambda i: F.try_element_at("lights", i)), lambda x: x.isNotNull()), 1)
    some = F.exists(F.coalesce("ahead", F.array().cast("array<bigint>")), lambda i: F.map_contains_key("lights", i))
    text = F.when(F.col("light_ahead").isNotNull(), F.col("light_ahead")).when(F.coalesce(F.size("ahead"), F.lit(0)) <= 0, "none").when(some, read).otherwise("unknown")
    return joined.select(*keys, "t_ns", text.alias("light"))


def context_window(rows: DataFrame, keys: Sequence[str], index: str, past: int, future: int) -> DataFrame:
    """rows with lo and hi, the first and last sample of each one's window, clipped to its key's samples [WN-11]."""
    every = Window.partitionBy(*keys)
    return rows.withColumn("lo", F.greatest(F.col(index) - past, F.min(index).over(every))).withColumn("hi", F.least(F.col(index) + future, F.max(index).over(every)))


def window_context(rows: DataFrame, value: str, flag: Column, keys: Sequence[str], index: str, past: int, future: int) -> DataFrame:
    """rows with change, high and low of the value over each one's window and how many rows are flagged in it [AG-13]."""
    w = Window.partitionBy(*keys).orderBy(index).rangeBetween(-past, future)
    return rows.withColumns({"change": F.last(value).over(w) - F.first(value).over(w), "high": F.max(value).over(w), "low": F.min(value).over(w), "flagged": F.sum(flag.cast("long")).over(w)})


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], what: str, name: str = "events") -> DataFrame:
    """keys and the array of what happened, by time and then by the further columns [TK-07]."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(what).alias("__what"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["__what"]).alias(name))
