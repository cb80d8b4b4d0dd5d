"""Words for lanes, moves between them and the indicator, as columns; aliases of lanes are rows of a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed_text

#: Codes of the indicator that a text names, and the code before its first message.
INDICATOR_TEXT = {2: "LEFT", 3: "RIGHT"}
INDICATOR_OFF = 1


def lane_kind(kind: Column, turn_direction: Column) -> Column:
    """What a lane is; a lane with a turn direction is an intersection's [FN-14]."""
    return F.when(turn_direction.isNotNull(), F.concat(F.lit("intersection lane, turn direction "), F.upper(turn_direction))).otherwise(kind)


def transition_text(relation: Column, before: Column, after: Column, after_kind: Column, after_turn: Column) -> Column:
    """A move between two lanes by their aliases; a null alias is off the map [FN-14]."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    inside = F.when(after_turn.isNotNull(), text(" (", lane_kind(after_kind, after_turn), ")")).otherwise("")
    return (
        F.when(before.isNull(), text("enters mapped lane ", after)).when(after.isNull(), text("leaves the mapped lanes (from ", before, ")"))
        .when(relation.isin("left", "right"), text("moves from ", before, " into its ", relation, " neighbor ", after))
        .when(relation.isin("following", "near"), text("continues from ", before, " into ", after, inside))
        .when(relation == "previous", text("moves back from ", before, " into ", after))
        .otherwise(text("moves from ", before, " into ", after, " (not directly connected)"))
    )


def lane_descriptions(named: DataFrame, lanes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lane_id, description: kind, neighbours and continuations of each lane that a sample names [FN-14].

    named: keys, lane_id, name; lanes: the shared type. Lanes that the sample doesn't name are told by their kind.
    A neighbour or continuation that the map lacks has an unknown kind.
    """
    about = lanes.select(F.col("id").alias("__to"), F.coalesce(F.col("kind"), F.lit("unknown")).alias("__kind"), F.col("turn_direction").alias("__turn"))
    alias = named.select(*keys, F.col("lane_id").alias("__to"), F.col("name").alias("__name"))
    own = named.join(lanes.select(F.col("id").alias("lane_id"), "kind", "turn_direction", "left", "left_crossable", "right", "right_crossable", "following"), "lane_id")
    roads = F.concat(
        F.array(F.struct(F.lit(0).alias("slot"), F.col("left").alias("to"), F.col("left_crossable").alias("open")), F.struct(F.lit(1).alias("slot"), F.col("right").alias("to"), F.col("right_crossable").alias("open"))),
        F.transform(F.coalesce("following", F.expr("array()").cast("array<long>")), lambda f, i: F.struct((i + 2).alias("slot"), f.cast("long").alias("to"), F.lit(None).cast("boolean").alias("open"))),
    )
    links = own.select(*keys, "lane_id", "name", "kind", "turn_direction", F.explode(roads).alias("__road")).withColumn("__to", F.col("__road.to"))
    links = links.join(about, "__to", "left").join(alias, [*keys, "__to"], "left")
    met = F.struct("__road.slot", "__road.to", "__road.open", F.col("__kind").alias("kind"), F.col("__turn").alias("turn"), F.col("__name").alias("name"))
    found = links.groupBy(*keys, "lane_id").agg(F.first("name").alias("name"), F.first("kind").alias("kind"), F.first("turn_direction").alias("turn"), F.array_sort(F.collect_list(met)).alias("roads"))
    missing = F.lit("unknown")

    def neighbour(side: str, slot: int) -> Column:
        road = F.element_at(F.filter("roads", lambda r: r["slot"] == slot), 1)
        who = F.coalesce(road["name"], F.concat(F.lit("a "), F.coalesce(road["kind"], missing), F.lit(" lane")))
        line = F.when(road["open"], " (dashed line, can be crossed)").otherwise(" (solid line)")
        return F.concat(F.lit(f"{side} neighbor: "), F.when(road["to"].isNull(), "none").otherwise(F.concat(who, line)))

    onward = F.filter("roads", lambda r: r["slot"] >= 2)
    names = F.transform(F.filter(onward, lambda r: r["name"].isNotNull()), lambda r: r["name"])
    others = F.array_sort(F.transform(F.filter(onward, lambda r: r["name"].isNull()), lambda r: F.coalesce(lane_kind(r["kind"], r["turn"]), missing)))
    told = F.concat(F.array_join(names, ", "), F.when((F.size(names) > 0) & (F.size(others) > 0), " and ").otherwise(""), F.when(F.size(others) > 0, F.concat(F.size(others).cast("string"), F.lit(" other lane(s) ("), F.array_join(others, ", "), F.lit(")"))).otherwise(""))
    several = (F.size(onward) >= 2) & ~F.col("kind").eqNullSafe("shoulder")
    fork = F.when(several, F.when(F.exists(onward, lambda r: r["turn"].isNull()), "the road forks here").otherwise("an intersection starts here"))
    parts = F.array(F.coalesce(lane_kind(F.col("kind"), F.col("turn")), missing), neighbour("left", 0), neighbour("right", 1), F.when(F.size(onward) > 0, F.concat(F.lit("leads into: "), told)), fork)
    return found.select(*keys, "lane_id", F.concat("name", F.lit(": "), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ")).alias("description"))


def time_text(nanos: Column) -> Column:
    """t=+1.5s: seconds from a sample's moment, with two digits where one can't say them."""
    tenths = nanos / 1e8
    near = F.greatest(F.lit(1e-9) * F.greatest(F.abs(tenths), F.abs(F.rint(tenths))), F.lit(1e-8))
    size = F.abs(nanos / 1e9)
    text = F.when(F.abs(tenths - F.rint(tenths)) <= near, fixed_text(size, 1)).otherwise(fixed_text(size, 2))
    return F.concat(F.when(nanos < 0, "t=-").otherwise("t=+"), text, F.lit("s"))


def indicator_states(messages: DataFrame, keys: Sequence[str], time: str, code: str, tie: Sequence[str] = ()) -> DataFrame:
    """keys, start, end, code: the times for which the indicator stays the same; the last one has no end."""
    w = Window.partitionBy(*keys).orderBy(time, *tie)
    starts = messages.withColumn("__before", F.lag(code, 1, INDICATOR_OFF).over(w)).filter(F.col(code) != F.col("__before"))
    return starts.select(*keys, F.col(time).alias("start"), F.lead(time).over(w).alias("end"), F.col(code).alias("code"))


def indicator_text(windows: DataFrame, states: DataFrame, keys: Sequence[str], now: str, lo: str, hi: str, width: int, texts: dict[int, str] = INDICATOR_TEXT, recorded: Column | None = None) -> DataFrame:
    """windows with `indicator`: the periods of named codes within [lo, hi], told from `now` [AG-25].

    A window is identified by keys and now. States without an end last to the end of every window; a state that begins
    at hi is told with no length. Windows meet states in buckets of `width`. Where `recorded` is false, the text says so.
    """
    named = states.filter(F.col("code").isin(*texts))
    last = windows.groupBy(*keys).agg(F.max(hi).alias("__last"))
    closed = named.join(last, list(keys)).withColumn("__end", F.coalesce("end", F.greatest("__last", "start") + 1)).drop("__last", "end")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.greatest(F.floor(F.col(a) / width), F.floor(F.col(b) / width)).cast("long")))
    met = windows.select(*keys, now, lo, hi).distinct().withColumn("__cell", span(lo, hi)).join(closed.withColumn("__cell", span("start", "__end")), [*keys, "__cell"])
    met = met.filter((F.col("start") <= F.col(hi)) & (F.col("__end") > F.col(lo)))
    met = met.filter(F.floor(F.greatest(F.col("start"), F.col(lo)) / width) == F.col("__cell"))
    word = F.create_map(*[F.lit(v) for pair in texts.items() for v in pair])[F.col("code")]
    begin, end = F.greatest("start", lo), F.least("__end", hi)
    text = F.concat(word, F.lit(" from "), time_text(begin - F.col(now)), F.lit(" to "), time_text(end - F.col(now)))
    told = met.groupBy(*keys, now, lo, hi).agg(F.array_sort(F.collect_list(F.struct(begin.alias("a"), end.alias("b"), text.alias("text")))).alias("__told"))
    never = F.lit("never on (no LEFT or RIGHT)")
    out = windows.join(told, [*keys, now, lo, hi], "left").withColumn("indicator", F.coalesce(F.array_join(F.transform("__told", lambda t: t["text"]), "; "), never)).drop("__told")
    return out if recorded is None else out.withColumn("indicator", F.when(recorded, F.col("indicator")).otherwise("not recorded in this log"))


def lane_trace(windows: DataFrame, lo: str, hi: str, every: int = 5, name: str = "i") -> DataFrame:
    """windows with `name`: the indices of [lo, hi] that are multiples of `every`, and lo and hi themselves, each once [WN-07]."""
    a, b = F.col(lo).cast("int"), F.col(hi).cast("int")
    first = a + F.pmod(-a, F.lit(every))
    steps = F.when(first <= b, F.sequence(first, b, F.lit(every))).otherwise(F.array().cast("array<int>"))
    return windows.withColumn(name, F.explode(F.array_sort(F.array_distinct(F.concat(F.array(a, b), steps)))))
