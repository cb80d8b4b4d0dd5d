"""Objects around moments: filters, tracks, their order of importance and what to show of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS_M, MOST, LEAST_EXISTENCE = 30.0, 8, 0.5


def ego_frame(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """(ahead, left) of a displacement [FN-03]."""
    return dx * F.cos(yaw) + dy * F.sin(yaw), -dx * F.sin(yaw) + dy * F.cos(yaw)


def believable(objects: DataFrame, x: str = "x", y: str = "y", existence: str = "existence") -> DataFrame:
    """Objects that likely exist and have a finite place; no existence value counts as certain [FLT-01, FN-17]."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return objects.filter((F.coalesce(F.col(existence), F.lit(1.0)) >= LEAST_EXISTENCE) & finite(x) & finite(y))


def within(objects: DataFrame, x: str = "x", y: str = "y", radius: float = RADIUS_M) -> DataFrame:
    """Objects within the radius, with their `distance` [FLT-02]."""
    return objects.withColumn("distance", F.hypot(F.col(x), F.col(y))).filter(F.col("distance") <= radius)


def first_sightings(objects: DataFrame, keys: Sequence[str], time: str, track: str, position: Sequence[str]) -> DataFrame:
    """One row for each track and time, the first by position; rows without a track are left out [AG-18]."""
    order = Window.partitionBy(*keys, time, track).orderBy(*position)
    return objects.filter(F.col(track).isNotNull()).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def tracks(objects: DataFrame, keys: Sequence[str], time: str, track: str, kind: str, position: Sequence[str]) -> DataFrame:
    """keys, track, kind (that seen first), n, min_distance and first and last time of the tracks that ever come within the radius."""
    seen = first_sightings(objects, keys, time, track, position)
    grouped = seen.groupBy(*keys, track).agg(
        F.min(F.struct(time, *position, F.col(kind).alias("__kind")))["__kind"].alias("kind"), F.count("*").alias("n"), F.min("distance").alias("min_distance"), F.min(time).alias("first"), F.max(time).alias("last")
    )
    return grouped.filter(F.col("min_distance") <= RADIUS_M)


def missing_ids(objects: DataFrame, keys: Sequence[str], track: str, radius: float = RADIUS_M) -> DataFrame:
    """keys and whether any object within the radius has no track [AG-19]."""
    return objects.groupBy(*keys).agg(F.bool_or(F.col(track).isNull() & (F.col("distance") <= radius)).alias("ids_missing"))


def top_tracks(found: DataFrame, keys: Sequence[str], order: Sequence, most: int = MOST) -> DataFrame:
    """The first `most` of each key with `rank`, and how many the key has in all, retained and omitted [TK-01, TK-02, TK-03]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy(*keys)))
    kept = ranked.filter(F.col("rank") <= most)
    return kept.withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0)))


def tier(stopped: Column, intrudes: Column, ahead: Column, clearance: Column) -> Column:
    """0 a stopped object in the way ahead, 1 closer than 3 m, 2 others; an unknown clearance is not close [TK-01]."""
    return F.when(F.coalesce(stopped & intrudes & ahead, F.lit(False)), 0).when(F.coalesce(clearance < 3, F.lit(False)), 1).otherwise(2)


def key_observations(observed: DataFrame, keys: Sequence[str], time: str, now: str, reasons: dict[str, Column], most: int = 9) -> DataFrame:
    """The rows that stand for a track, in time order, with why [WN-26].

    reasons: for each, a sort key whose smallest value picks its row, null where the row can't stand for it; earlier
    reasons come first when more than `most` rows would be kept.
    """
    listed = observed.withColumn("__at", F.col(time))
    picks = None
    for order, (name, key) in enumerate(reasons.items()):
        w = Window.partitionBy(*keys).orderBy(key.asc(), F.col("__at"))
        part = listed.withColumn("__k", key).filter("__k is not null").withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*observed.columns, F.lit(order).alias("__o"), F.lit(name).alias("__n"))
        picks = part if picks is None else picks.unionByName(part)
    by = [*keys, time]
    merged = picks.groupBy(*by).agg(F.min("__o").alias("__o"), F.transform(F.array_sort(F.collect_list(F.struct("__o", "__n"))), lambda x: x["__n"]).alias("reasons"), F.first(now).alias(now))
    w = Window.partitionBy(*keys).orderBy("__o")
    return merged.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r", "__o")


def landmarks(rows: DataFrame, vx: str, vy: str, height: str, kind: str, kinds: Sequence[str], most_speed: float = 0.2, most_height: float = 5.0) -> DataFrame:
    """Objects that stand still, are of a plausible height and of kinds that stay in place [FLT-09]."""
    still = F.col(vx) * F.col(vx) + F.col(vy) * F.col(vy) <= most_speed * most_speed
    return rows.filter(still & (F.col(height) > 0) & (F.col(height) < most_height) & F.col(kind).isin(*kinds))


def object_tracks(found: DataFrame, keys: Sequence[str], time: str, track: str, kind: str, position: Sequence[str], most: int = MOST) -> DataFrame:
    """The nearest tracks of each key among believable objects, those that ever come within the radius [OR-13]."""
    measured = believable(found).withColumn("distance", F.hypot("x", "y"))
    return top_tracks(tracks(measured, keys, time, track, kind, position), keys, ["min_distance", track], most)


def anchors(observations: DataFrame, keys: Sequence[str], time: str = "time_s", clearance: str = "clearance", share: str = "share", least: float = 0.01, near: float = 0.3) -> DataFrame:
    """The observations of a moving object that its history shows, with `reasons` in fixed order [WN-27].

    Per key: the first and last, the nearest to time 0 if within `near`, the closest, that of the largest share, and the
    first and last whose share is above `least` with their neighbours outside. The earliest of equals counts; times
    within a key are distinct.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    whole = Window.partitionBy(*keys)
    inside = F.col(share) > least
    rows = observations.withColumn("__k", F.row_number().over(w))
    k = F.col("__k")
    at = {
        "__n": F.count(F.lit(1)), "__now": F.min(F.struct(F.abs(time).alias("d"), k)), "__close": F.min(F.struct(F.col(clearance).alias("d"), k)),
        "__most": F.min(F.struct((-F.col(share)).alias("d"), k)), "__in": F.min(F.when(inside, k)), "__out": F.max(F.when(inside, k)),
    }
    rows = rows.withColumns({name: value.over(whole) for name, value in at.items()})
    here = lambda name: k == F.col(f"{name}.__k")
    #: The reasons, in the order in which a history names them.
    reasons = (
        (k == 1, "first observation"), (k == F.col("__n"), "last observation"), (here("__now") & (F.col("__now.d") <= near), "NOW"), (here("__close"), "closest body passage"), (here("__most"), "maximum overlap"),
        (k == F.col("__in"), "first observed overlap"), (k == F.col("__out"), "last observed overlap"), (k == F.col("__in") - 1, "last clear before overlap"), (k == F.col("__out") + 1, "first observed clear"),
    )
    named = F.filter(F.array(*[F.when(test, name) for test, name in reasons]), lambda r: r.isNotNull())
    return rows.withColumn("reasons", named).filter(F.size("reasons") > 0).drop("__k", *at)
