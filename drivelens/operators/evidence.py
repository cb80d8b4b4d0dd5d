"""Evidence about the past and near future of moments: actors beside the ego, forks that it took, its body in its lanes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry, lanes
from .asof import interpolate, supported

#: The ego's body (its centre lies ahead of the pose), and how near in time its poses must lie.
EGO_LENGTH, EGO_WIDTH, EGO_FORWARD, EGO_GAP_NS = 5.176, 2.297, 1.461, 200_000_000
#: Metres of a branch and of its approach that a fork is judged by, the least of both, and degrees.
BRANCH_M, APPROACH_M, LEAST_M, SPREAD_DEG, MOST_DEG = 20.0, 10.0, 5.0, 5.0, 90.0


def actor_observations(actors: DataFrame, ego: DataFrame, connector: np.ndarray | None = None, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Actors in the ego's frame at their own times, where the ego's poses support one [GE-09, JN-09, GE-07].

    actors: keys, t_ns, track_id, x, y, yaw, speed, length_m, width_m; ego: keys, t_ns, x, y, yaw (unwrapped).
    connector_fraction is the share of an actor's footprint on the connector, null without one.
    """
    keys = list(keys)
    finite = F.lit(True)
    for c in ("x", "y", "yaw", "speed", "length_m", "width_m"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    seen = actors.filter(finite & (F.col("length_m") > 0) & (F.col("width_m") > 0))
    poses = ego.select(*keys, F.col("t_ns").alias("__t0"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("yaw").alias("eyaw"))
    placed = supported(interpolate(seen, poses, keys, "t_ns", "__t0", ["ex", "ey", "eyaw"]), EGO_GAP_NS).drop("gap", "bracket")

    def measure(batches):
        for rows in batches:
            x, y, yaw, ex, ey, eyaw, length, width = (rows[c].to_numpy(float) for c in ("x", "y", "yaw", "ex", "ey", "eyaw", "length_m", "width_m"))
            cos, sin = np.cos(eyaw), np.sin(eyaw)
            n = len(rows)
            bodies = geometry.rectangles(x, y, yaw, length, width)
            own = geometry.rectangles(ex + EGO_FORWARD * cos, ey + EGO_FORWARD * sin, eyaw, np.full(n, EGO_LENGTH), np.full(n, EGO_WIDTH))
            share = [None] * n if connector is None else list(geometry.overlap_areas(connector, bodies) / (length * width))
            yield rows.drop(columns=["ex", "ey", "eyaw"]).assign(
                ahead_m=cos * (x - ex) + sin * (y - ey), left_m=cos * (y - ey) - sin * (x - ex), center_distance_m=np.hypot(x - ex, y - ey),
                clearance_m=[geometry.clearances(b[None], o)[0] for b, o in zip(bodies, own, strict=True)], connector_fraction=pd.array(share, dtype="Float64"), relative_yaw=lanes._wrap(yaw - eyaw),
            )

    fields = ", ".join(f"{c} {t}" for c, t in placed.dtypes if c not in ("ex", "ey", "eyaw"))
    return placed.mapInPandas(measure, f"{fields}, ahead_m double, left_m double, center_distance_m double, clearance_m double, connector_fraction double, relative_yaw double")


def path_heading(line: np.ndarray, length: float, end: bool = False) -> float | None:
    """Heading over the first, or last, `length` of a line, or over the whole of a shorter one of at least 5 m [FN-06]."""
    along = float(np.linalg.norm(np.diff(line, axis=0), axis=1).sum())
    if along < LEAST_M:
        return None
    length = min(length, along)
    a, b = (geometry.at_station(line, along - length), line[-1]) if end else (line[0], geometry.at_station(line, length))
    return math.atan2(b[1] - a[1], b[0] - a[0])


def branch_sides(approach: np.ndarray, branches: Sequence[np.ndarray]) -> list[tuple[str, float]] | None:
    """LEFT, RIGHT, MIDDLE or UNKNOWN and the angle of each branch of a fork; None if it is no clear fork [WN-24].

    All branches are compared over the length that the shortest has. Nearly parallel or backward branches are no fork.
    An outermost branch has its side only if the next one is SPREAD_DEG away; branches between are in the middle.
    """
    reach = min(BRANCH_M, *(np.linalg.norm(np.diff(b, axis=0), axis=1).sum() for b in branches)) if len(branches) > 1 else 0.0
    if reach < LEAST_M:
        return None
    headings = np.array([path_heading(approach, APPROACH_M, end=True), *(path_heading(b, float(reach)) for b in branches)], dtype=float)
    angles = np.degrees(lanes._wrap(headings[1:] - headings[0]))
    order = np.argsort(angles, kind="stable")
    gaps = np.diff(angles[order])
    # a missing heading makes the comparison false
    if not (gaps.sum() >= SPREAD_DEG and np.abs(angles).max() < MOST_DEG):
        return None
    names = np.full(len(angles), "MIDDLE", dtype=object)
    for end, gap, name in ((order[0], gaps[0], "RIGHT"), (order[-1], gaps[-1], "LEFT")):
        names[angles == angles[end]] = name if gap >= SPREAD_DEG else "UNKNOWN"
    return list(zip(names.tolist(), angles.tolist(), strict=True))


def forks(track: DataFrame, lane_table: DataFrame, edges: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "k", valid: str = "valid") -> DataFrame:
    """keys, order, source, chosen and side of each observed step from a lane into one of its several continuations [WN-24].

    Steps across invalid samples don't count, nor do forks in intersections or onto shoulders.
    """
    keys = list(keys)
    broken = F.sum((~F.col(valid)).cast("int")).over(_running(keys, order))
    rows = track.withColumn("__part", broken).filter(valid)
    moved = lanes.lane_changes(rows, edges, [*keys, "__part"], order).filter("relation = 'following'")
    road = lane_table.filter(F.col("turn_direction").isNull() & ~F.col("kind").isin("shoulder", "road_shoulder"))
    source = road.filter(F.size("following") >= 2).select(F.col("id").alias("a"), F.col("centerline").alias("approach"), F.array_distinct("following").alias("options"))
    ways = source.select("a", F.posexplode("options").alias("at", "id")).join(road.select("id", "centerline"), "id", "left").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("at", "id", "centerline"))).alias("ways"), F.bool_and(F.col("centerline").isNotNull()).alias("whole")).filter("whole")
    judged = moved.select(*keys, order, "a", "b").join(source.drop("options"), "a").join(ways.drop("whole"), "a")

    def judge(batches):
        points = lambda line: np.array([[p["x"], p["y"]] for p in line])
        for group in batches:
            out = []
            for r in group.to_dict("records"):
                sides = branch_sides(points(r["approach"]), [points(w["centerline"]) for w in r["ways"]])
                if sides is not None:
                    side, angle = sides[[w["id"] for w in r["ways"]].index(r["b"])]
                    out.append((*(r[k] for k in keys), r[order], r["a"], r["b"], side, angle))
            yield pd.DataFrame(out, columns=[*keys, order, "source", "chosen", "side", "angle"])

    kinds = dict(track.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order])
    return judged.mapInPandas(judge, f"{fields}, source long, chosen long, side string, angle double")


def _running(keys: Sequence[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


def body_evidence(poses: DataFrame, found: DataFrame, reference: DataFrame, lane_table: DataFrame, length: float = EGO_LENGTH, width: float = EGO_WIDTH, forward: float = EGO_FORWARD) -> DataFrame:
    """Shares of the body at each pose: inside and outside of the reference lanes, mapped, ambiguous [GE-05, OR-08].

    poses: pose_id, session_id, x, y, yaw; found: pose_id, lane_id of lanes near a pose; reference: session_id, lane_id
    of the chain that is driven. Shares of poses whose reference has a lane without a polygon are null inside and outside.
    """
    shapes = lane_table.select(F.col("id").alias("lane_id"), "polygon")
    near = found.select("pose_id", "lane_id").distinct().join(shapes, "lane_id").filter("polygon is not null").groupBy("pose_id").agg(F.collect_list(F.struct("lane_id", "polygon")).alias("near"))
    chain = reference.join(shapes, "lane_id", "left").groupBy("session_id").agg(F.sort_array(F.collect_set("lane_id")).alias("chain"), F.bool_and(F.col("polygon").isNotNull()).alias("whole"))
    rows = poses.join(near, "pose_id", "left").join(chain, "session_id", "left")

    def measure(batches):
        for group in batches:
            out = []
            for r in group.to_dict("records"):
                c, s = math.cos(r["yaw"]), math.sin(r["yaw"])
                body = geometry.rectangle(r["x"] + forward * c, r["y"] + forward * s, r["yaw"], length, width)
                near_lanes = [(w["lane_id"], np.array([[p["x"], p["y"]] for p in w["polygon"]])) for w in (r["near"] if r["near"] is not None else [])]
                got = geometry.occupancy(body, near_lanes, list(r["chain"]) if r["chain"] is not None else [])
                known = bool(r["whole"]) and body is not None
                out.append((r["pose_id"], got["mapped"], got["ambiguous"], got["inside"] if known else None, got["outside"] if known else None))
            yield pd.DataFrame(out, columns=["pose_id", "mapped", "ambiguous", "inside", "outside"])

    return rows.select("pose_id", "x", "y", "yaw", "near", "chain", "whole").mapInPandas(measure, "pose_id long, mapped double, ambiguous double, inside double, outside double")


def outside_state(outside: Column, lateral: Column) -> Column:
    """Whether a body has left its lane sideways: true, false or null when its side is not known [GE-05, AG-16]."""
    return F.when(outside <= geometry.DEPARTED, F.lit(False)).when(outside > geometry.DEPARTED, lateral)
