"""A vehicle's body over lanes and borders: joins in grid cells, areas in whole batches, borders in Spark's expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry

CELL_M = 25.0
LEAST_AREA = 1e-8
LEAST_LENGTH = 0.01
BOX = ("x0", "y0", "x1", "y1")


def outline_box(outline: Column) -> Column:
    """struct<x0, y0, x1, y1> around array<struct<x, y>>."""
    ends = lambda f, axis: f(F.transform(outline, lambda p: p[axis]))
    return F.struct(ends(F.array_min, "x").alias("x0"), ends(F.array_min, "y").alias("y0"), ends(F.array_max, "x").alias("x1"), ends(F.array_max, "y").alias("y1"))


def _in_cells(rows: DataFrame, box: str, cell: float) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(box)[a] / cell).cast("long"), F.floor(F.col(box)[b] / cell).cast("long")))
    return rows.withColumn("__cx", span("x0", "x1")).withColumn("__cy", span("y0", "y1"))


def meeting_boxes(left: DataFrame, right: DataFrame, left_box: str, right_box: str, keys: Sequence[str] = (), cell: float = CELL_M) -> DataFrame:
    """Every pair whose boxes meet, once: in the cell of the lower corner of what they share. Null boxes meet nothing.

    A row is sent to each cell that its box covers, so cells should not be much smaller than the boxes.
    """
    a, b = F.col(left_box), F.col(right_box)
    pairs = _in_cells(left.filter(a["x0"].isNotNull()), left_box, cell).join(_in_cells(right.filter(b["x0"].isNotNull()), right_box, cell), [*keys, "__cx", "__cy"])
    meet = (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
    corner = lambda axis: F.floor(F.greatest(a[axis], b[axis]) / cell)
    return pairs.filter(meet & (corner("x0") == F.col("__cx")) & (corner("y0") == F.col("__cy"))).drop("__cx", "__cy")


def occupied_lanes(bodies: DataFrame, lanes: DataFrame, cell: float = CELL_M) -> DataFrame:
    """body columns, lane_id, fraction: the share of a body's area in each lane that it covers more than a trace of [JN-12].

    bodies: any columns and body, array<struct<x, y>> of a convex outline, of one number of corners for all; lanes: id, polygon.
    Polygons may be concave and turn either way. Bodies and polygons that are null cover nothing.
    """
    names = [c for c in bodies.columns if c != "body"]
    pairs = meeting_boxes(bodies.withColumn("__box", outline_box(F.col("body"))), lanes.select(F.col("id").alias("lane_id"), "polygon", outline_box(F.col("polygon")).alias("__lane")), "__box", "__lane", (), cell)
    flat = lambda p: F.flatten(F.transform(p, lambda q: F.array(q["x"], q["y"])))
    rows = pairs.select(*names, "lane_id", flat(F.col("body")).alias("__body"), flat(F.col("polygon")).alias("__polygon"))

    def run(batches):
        for part in batches:
            out = part[[*names, "lane_id"]].assign(fraction=0.0)
            for _, same in part.groupby("lane_id", sort=False):
                corners = np.stack(same["__body"].to_list()).reshape(len(same), -1, 2)
                shared = geometry.shared_areas(np.asarray(same["__polygon"].iloc[0]).reshape(-1, 2), corners)
                whole = geometry.polygon_areas(corners)
                out.loc[same.index, "fraction"] = np.where(shared > LEAST_AREA, np.clip(shared / np.maximum(whole, 1e-300), 0, 1), np.nan)
            yield out.dropna(subset=["fraction"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in [*names, "lane_id"]], "fraction double"]))


def border_inside(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column, yaw: Column, length: Column, width: Column) -> Column:
    """How much of the segment from a to b lies in the rectangle around (x, y), in metres."""
    c, s = F.cos(yaw), F.sin(yaw)
    along = lambda px, py: c * (px - x) + s * (py - y)
    across = lambda px, py: c * (py - y) - s * (px - x)

    def part(p: Column, q: Column, half: Column) -> tuple[Column, Column]:
        d = q - p
        flat = F.abs(d) < 1e-12
        enter, leave = F.least((-half - p) / d, (half - p) / d), F.greatest((-half - p) / d, (half - p) / d)
        within = F.abs(p) <= half
        return F.when(flat, F.when(within, 0.0).otherwise(1.0)).otherwise(enter), F.when(flat, F.when(within, 1.0).otherwise(0.0)).otherwise(leave)

    u0, u1 = part(along(ax, ay), along(bx, by), length / 2)
    v0, v1 = part(across(ax, ay), across(bx, by), width / 2)
    return F.greatest(F.least(u1, v1, F.lit(1.0)) - F.greatest(u0, v0, F.lit(0.0)), F.lit(0.0)) * F.hypot(bx - ax, by - ay)


def crossed_sides(bodies: DataFrame, edges: DataFrame, keys: Sequence[str], cell: float = CELL_M) -> DataFrame:
    """keys, sides: on which sides of its reference a body lies over borders, sorted; bodies over none are left out [JN-13].

    bodies: keys, x, y (centre), yaw, length, width, and the reference's foot_x, foot_y, tx, ty (unit tangent); edges: ax,
    ay, bx, by. Only edges within 60 degrees of the reference's direction count, with more than LEAST_LENGTH inside.
    """
    body = geometry.rectangle_column(*[F.col(c) for c in ("x", "y", "yaw", "length", "width")])
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    pairs = meeting_boxes(bodies.withColumn("__box", outline_box(body)), edges.select("ax", "ay", "bx", "by", outline_box(ends).alias("__edge")), "__box", "__edge", (), cell)
    col = F.col
    size = F.hypot(col("bx") - col("ax"), col("by") - col("ay"))
    lateral = (size >= 1e-8) & (F.abs((col("bx") - col("ax")) * col("tx") + (col("by") - col("ay")) * col("ty")) >= 0.5 * size)
    over = border_inside(*[col(c) for c in ("ax", "ay", "bx", "by", "x", "y", "yaw", "length", "width")]) > LEAST_LENGTH
    offset = ((col("ay") + col("by")) / 2 - col("foot_y")) * col("tx") - ((col("ax") + col("bx")) / 2 - col("foot_x")) * col("ty")
    return pairs.filter(lateral & over).groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(offset > 0, "left").otherwise("right"))).alias("sides"))


def centred_body(foot_x: Column, foot_y: Column, tx: Column, ty: Column, length: Column, width: Column, forward: float = 0.0) -> Column:
    """The outline that the body would have with its reference point on the lane's centre line, along its tangent [GE-08]."""
    return geometry.rectangle_column(foot_x + forward * tx, foot_y + forward * ty, F.atan2(ty, tx), length, width)
