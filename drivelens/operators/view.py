"""Geometry of views from above: footprints, screens, and ribbons of a path cut at the ends of scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN_M = 6.0


def positive_or(value: Column, fallback: Column) -> Column:
    """A finite value above 0, else the fallback."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf")), value).otherwise(fallback)


def ego_centre(x: Column, y: Column, yaw: Column, forward: Column) -> tuple[Column, Column]:
    """The body's centre for a pose of the rear axle [GE-16]."""
    return x + forward * F.cos(yaw), y + forward * F.sin(yaw)


def _turned(x: Column, y: Column, pose_x: Column, pose_y: Column, yaw: Column) -> tuple[Column, Column]:
    dx, dy, c, s = x - pose_x, y - pose_y, F.cos(yaw), F.sin(yaw)
    return c * dx + s * dy, s * dx - c * dy


def screen_point(x: Column, y: Column, pose_x: Column, pose_y: Column, yaw: Column, width: float, height: float, scale: Column, anchor: float = 0.65) -> tuple[Column, Column]:
    """Pixels of a point in a view that turns with the pose, which stands at the anchor's share of the height [GE-16]."""
    ahead, right = _turned(x, y, pose_x, pose_y, yaw)
    return width / 2 + right * scale, height * anchor - ahead * scale


def fit_scale(points: Column, pose_x: Column, pose_y: Column, yaw: Column, width: float, height: float, base: float, anchor: float = 0.65, top: float = 0.0) -> Column:
    """The largest scale up to base at which every point, array<struct<x, y>>, and a margin fit the view [GE-16]."""

    def fits(p: Column) -> Column:
        ahead, right = _turned(p["x"], p["y"], pose_x, pose_y, yaw)
        front = F.when(ahead > 0, max(1.0, height * anchor - top) / (ahead + MARGIN_M))
        back = F.when(ahead < 0, height * (1 - anchor) / (MARGIN_M - ahead))
        return F.least(front, back, width / 2 / (F.abs(right) + MARGIN_M))

    return F.least(F.lit(float(base)), F.array_min(F.transform(points, fits)))


def ribbon(sections: DataFrame, scenes: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys, time, start, end, from_left, from_right, to_left, to_right, label: pieces of a path's ribbon, cut where scenes begin or end [GE-17].

    sections: keys, time (whole numbers, distinct within a key), left and right struct<x, y>, and connect: whether a
    section continues the one before. scenes: keys, start, end, label, without overlaps. A piece's edge points lie on the
    section's straight sides; label is null outside of scenes. time is that of the section that a piece belongs to.
    Sections meet cuts in buckets of `width`.
    """
    from .intervals import label_at

    w = Window.partitionBy(*keys).orderBy("time")
    before = lambda c: F.lag(c).over(w).alias(f"__{c}")
    quads = sections.select(*keys, "time", "left", "right", "connect", before("time"), before("left"), before("right")).filter(F.col("connect") & (F.col("__time") < F.col("time"))).drop("connect")
    cell = lambda t: F.floor(t / width).cast("long")
    cuts = scenes.select(*keys, F.explode(F.array("start", "end")).alias("__cut")).distinct().withColumn("__cell", cell(F.col("__cut")))
    covered = quads.select(*keys, "time", "__time", F.explode(F.sequence(cell(F.col("__time")), cell(F.col("time")))).alias("__cell"))
    within = covered.join(cuts, [*keys, "__cell"]).filter((F.col("__cut") > F.col("__time")) & (F.col("__cut") < F.col("time")))
    marks = within.groupBy(*keys, "time").agg(F.array_sort(F.collect_set("__cut")).alias("__cuts"))
    ends = F.concat(F.array("__time"), F.coalesce("__cuts", F.array().cast(f"array<{dict(quads.dtypes)['time']}>")), F.array("time"))
    steps = F.transform(F.sequence(F.lit(1), F.size("__ends") - 1), lambda i: F.struct(F.element_at("__ends", i).alias("a"), F.element_at("__ends", i + 1).alias("b")))
    pieces = quads.join(marks, [*keys, "time"], "left").withColumn("__ends", ends).withColumn("__step", F.explode(steps)).withColumn("start", F.col("__step.a")).withColumn("end", F.col("__step.b"))

    def at(side: str, moment: str) -> Column:
        share = (F.col(moment) - F.col("__time")) / (F.col("time") - F.col("__time"))
        a, b = F.col(f"__{side}"), F.col(side)
        return F.struct(*[(a[axis] + (b[axis] - a[axis]) * share).alias(axis) for axis in ("x", "y")])

    # no scene begins or ends within a piece, so what holds at its start holds in its middle
    shown = pieces.select(*keys, "time", "start", "end", *[at(side, moment).alias(f"{name}_{side}") for name, moment in (("from", "start"), ("to", "end")) for side in ("left", "right")])
    return label_at(shown, scenes.select(*keys, "start", "end", "label"), keys, "start", "label")
