"""Lane tables from map files."""

from __future__ import annotations

import math
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlite

VEHICLE_LANES = ("road", "highway", "road_shoulder")
_ENVELOPE = (0, 32, 48, 48, 64)


def geometry_points(blob: bytes) -> np.ndarray:
    """Points of the outline or line in a GeoPackage geometry: past its header, well-known binary [SRC-10].

    Of several parts the one with most points counts.
    """
    return _wkb(blob, 8 + _ENVELOPE[(blob[3] >> 1) & 7])[0]


def _wkb(data: bytes, at: int) -> tuple[np.ndarray, int]:
    order = "<" if data[at] else ">"
    kind, count = struct.unpack_from(order + "II", data, at + 1)
    extra = kind // 1000 if kind < 1 << 28 else bool(kind >> 31) + bool(kind >> 30 & 1)
    width, kind = 2 + (0, 1, 1, 2)[extra] if kind < 1 << 28 else 2 + extra, kind % 1000 if kind < 1 << 28 else kind & 0xFF
    at += 9

    def points(n: int, at: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(float), at + 8 * n * width

    if kind == 2:
        return points(count, at)
    parts = []
    for _ in range(count):
        if kind == 3:
            (n,) = struct.unpack_from(order + "I", data, at)
            part, at = points(n, at + 4)
        else:
            part, at = _wkb(data, at)
        parts.append(part)
    # a polygon's first ring is its outline
    return (parts[0] if kind == 3 else max(parts, key=len)), at


def find_map(root: str, location: str, version: str | None = None) -> Path:
    """The map file of a location: of the version if there is one, else of the newest that has one, by its numbers [SRC-11]."""
    folder = Path(root) / location
    versions = [p.name for p in folder.iterdir() if (p / "map.gpkg").exists()] if folder.is_dir() else []
    if not versions:
        raise FileNotFoundError(f"no map of {location} under {root}")
    return folder / (version if version in versions else max(versions, key=lambda v: [int(x) for x in v.split(".") if x.isdigit()])) / "map.gpkg"


def utm(lon: np.ndarray, lat: np.ndarray, zone: int) -> np.ndarray:
    """Easting and northing (m) of the zone, northern hemisphere, by the series of Krueger to the fourth order [GE-10]."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t**2))
    x = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    y = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return np.column_stack([500000 + 0.9996 * radius * x, 0.9996 * radius * y])


def geopackage_lanes(spark: SparkSession, path: str) -> DataFrame:
    """Lanes and lane connectors of a GeoPackage in the form of schemas.LANE, points in metres [SRC-09, SRC-18, ST-05].

    Neighbours share a boundary; connectors follow their exit lane and precede their entry lane; those of a signalised
    intersection are their own light.
    """
    table = lambda query, schema: sqlite.read(spark, [path], query, schema).drop("path")
    system = dict(table("select key, value from meta", "key string, value string").collect())["projectedCoordSystem"]
    zone = int(system.rsplit(":", 1)[-1]) % 100

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def points(blobs: pa.Array) -> pa.Array:
        # a null geometry is an empty list here and masked below
        found = [geometry_points(b) if b is not None else np.zeros((0, 2)) for b in blobs.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([np.zeros((0, 2)), *(f[:, :2] for f in found)])
        metres = utm(flat[:, 0], flat[:, 1], zone)
        pair = pa.StructArray.from_arrays([pa.array(metres[:, 0]), pa.array(metres[:, 1])], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair, mask=blobs.is_null())

    line = table("select geom, coalesce(lane_fid, lane_connector_fid) from baseline_paths", "geom binary, id long").select("id", points("geom").alias("centerline"))
    lane = table("select geom, lane_fid, left_boundary_fid, right_boundary_fid from lanes_polygons", "geom binary, id long, lb long, rb long")
    joint = table("select fid, exit_lane_fid, entry_lane_fid, intersection_fid from lane_connectors", "id long, from_lane long, to_lane long, crossing long")
    shape = table("select geom, lane_connector_fid from gen_lane_connectors_scaled_width_polygons", "geom binary, id long").select("id", points("geom").alias("polygon"))
    signal = table("select fid, intersection_type_fid from intersections", "crossing long, kind long").filter("kind = 2").select("crossing", F.lit(True).alias("signal"))
    if not lane.select("id").intersect(joint.select("id")).isEmpty():
        raise ValueError(f"{path}: lanes and connectors share ids")
    dashed = table("select fid, boundary_type_fid from boundaries", "b long, kind long")
    crossable = dashed.select("b", F.col("kind").isin(0, 2).alias("open"))
    side = lambda own, other, name: lane.alias("a").join(lane.alias("b"), F.col(f"a.{own}") == F.col(f"b.{other}")).filter("a.id <> b.id").groupBy(F.col("a.id").alias("id")).agg(F.min("b.id").alias(name))
    open_side = lambda own, name: lane.join(crossable, lane[own] == crossable["b"], "left").select("id", F.coalesce("open", F.lit(False)).alias(name))
    onward = joint.select(F.col("from_lane").alias("id"), F.col("id").alias("to")).unionByName(joint.select("id", F.col("to_lane").alias("to")))
    following = onward.groupBy("id").agg(F.sort_array(F.collect_set("to")).alias("following"))
    previous = onward.groupBy(F.col("to").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("previous"))
    none = F.array().cast("array<bigint>")
    roads = lane.select("id", F.lit("road").alias("kind"), points("geom").alias("polygon"), none.alias("traffic_lights"))
    joints = joint.join(signal, "crossing", "left").join(shape, "id", "left").select("id", F.lit("connector").alias("kind"), "polygon", F.when(F.col("signal"), F.array("id")).otherwise(none).alias("traffic_lights"))
    out = roads.unionByName(joints).join(line, "id")
    for part in (side("lb", "rb", "left"), open_side("lb", "left_crossable"), side("rb", "lb", "right"), open_side("rb", "right_crossable"), following, previous):
        out = out.join(part, "id", "left")
    out = out.withColumn("turn_direction", F.when(F.col("kind") == "connector", _turn()))
    return out.select("id", "kind", "turn_direction", "left", "left_crossable", "right", "right_crossable", F.coalesce("following", none).alias("following"), F.coalesce("previous", none).alias("previous"), "centerline", "polygon", "traffic_lights")


def _turn():
    from ..functions.scalars import turn_direction

    return turn_direction(F.col("centerline"))


_TAGS = "array<struct<_k:string,_v:string>>"


def osm_lanes(spark: SparkSession, path: str) -> DataFrame:
    """Lanelets of an OSM file with local coordinates, in the form of schemas.LANE [SRC-12, SRC-13, OR-09, OR-10].

    Lanes follow where the ends of both borders are the next one's beginnings, and are neighbours where they share a
    border. A point without local coordinates is an error.
    """
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    tag = lambda name: F.try_element_at(F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(_TAGS)), lambda t: F.struct(t["_k"], t["_v"]))), F.lit(name))
    node = xml("node", f"_id long, tag {_TAGS}").select(F.col("_id").alias("ref"), tag("local_x").cast("double").alias("x"), tag("local_y").cast("double").alias("y"))
    node = node.withColumn("x", F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.concat(F.lit("no local coordinates of point "), F.col("ref").cast("string"))).cast("double")).otherwise(F.col("x")))
    way = xml("way", f"_id long, nd array<struct<_ref:long>>, tag {_TAGS}").select(F.col("_id").alias("way"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tag("type").alias("type"), tag("subtype").alias("subtype"))
    placed = way.select("way", F.posexplode("refs").alias("at", "ref")).join(node, "ref").groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    border = way.join(placed, "way").select("way", "refs", "points", F.coalesce((F.col("type") == "virtual") | F.contains("subtype", F.lit("dashed")), F.lit(False)).alias("open"))
    relation = xml("relation", f"_id long, member array<struct<_role:string,_ref:long>>, tag {_TAGS}").select(F.col("_id").alias("id"), "member", tag("type").alias("type"), tag("subtype").alias("subtype"), tag("turn_direction").alias("turn_direction"))
    role = lambda name: F.try_element_at(F.filter("member", lambda m: m["_role"] == name), F.lit(1))["_ref"]
    lane = relation.filter((F.col("type") == "lanelet") & F.col("subtype").isin(*VEHICLE_LANES)).select("id", F.col("subtype").alias("kind"), "turn_direction", role("left").alias("lw"), role("right").alias("rw"), F.transform(F.filter("member", lambda m: m["_role"] == "regulatory_element"), lambda m: m["_ref"]).alias("rules"))
    of = lambda s: border.select(F.col("way").alias(f"{s}w"), F.col("refs").alias(f"{s}_refs"), F.col("points").alias(f"{s}_points"), F.col("open").alias(f"{s}_open"))
    lane = lane.join(of("l"), "lw").join(of("r"), "rw")
    # a border drawn against the lane's direction begins nearer to the other border's end
    gap = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    against = gap(first("l_points"), first("r_points")) + gap(last("l_points"), last("r_points")) > gap(first("l_points"), last("r_points")) + gap(last("l_points"), first("r_points"))
    lane = lane.withColumn("turned", against).withColumn("r_refs", F.when(F.col("turned"), F.reverse("r_refs")).otherwise(F.col("r_refs"))).withColumn("r_points", F.when(F.col("turned"), F.reverse("r_points")).otherwise(F.col("r_points")))
    ends = lane.select("id", first("l_refs").alias("l0"), last("l_refs").alias("l1"), first("r_refs").alias("r0"), last("r_refs").alias("r1"))
    meet = ends.select(F.col("id").alias("a"), F.col("l1").alias("l"), F.col("r1").alias("r")).join(ends.select(F.col("id").alias("b"), F.col("l0").alias("l"), F.col("r0").alias("r")), ["l", "r"]).filter("a <> b")
    beside = lambda mine, theirs, name: lane.select("id", F.col(mine).alias("w")).join(lane.select(F.col("id").alias("other"), F.col(theirs).alias("w")), "w").filter("id <> other").groupBy("id").agg(F.min("other").alias(name))
    lights = relation.filter((F.col("type") == "regulatory_element") & (F.col("subtype") == "traffic_light")).select(F.col("id").alias("rule"))
    own = lane.select("id", F.explode("rules").alias("rule")).join(lights, "rule").groupBy("id").agg(F.sort_array(F.collect_set("rule")).alias("traffic_lights"))
    middle = F.transform(F.sequence(F.lit(1), F.least(F.size("l_points"), F.size("r_points"))), lambda i: F.struct(((F.element_at("l_points", i)["x"] + F.element_at("r_points", i)["x"]) / 2).alias("x"), ((F.element_at("l_points", i)["y"] + F.element_at("r_points", i)["y"]) / 2).alias("y")))
    out = lane.select("id", "kind", "turn_direction", F.col("l_open").alias("left_crossable"), F.col("r_open").alias("right_crossable"), middle.alias("centerline"), F.concat("r_points", F.reverse("l_points")).alias("polygon"))
    for part in (beside("lw", "rw", "left"), beside("rw", "lw", "right"), meet.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("b")).alias("following")), meet.groupBy(F.col("b").alias("id")).agg(F.sort_array(F.collect_set("a")).alias("previous")), own):
        out = out.join(part, "id", "left")
    none = F.array().cast("array<bigint>")
    return out.select("id", "kind", "turn_direction", "left", "left_crossable", "right", "right_crossable", F.coalesce("following", none).alias("following"), F.coalesce("previous", none).alias("previous"), "centerline", "polygon", F.coalesce("traffic_lights", none).alias("traffic_lights"))
