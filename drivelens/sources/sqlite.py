"""SQLite files as Spark tables, a partition for each file, and drive logs made of them.

Joins of a log's tables are Spark's, so that a thousand logs are read and joined by a thousand tasks.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions import scalars
from ..operators.intervals import keep_apart

#: Kinds that objects' categories stand for; others are objects.
KINDS = {"vehicle": "car", "bicycle": "bicycle", "pedestrian": "pedestrian", "traffic_cone": "traffic_cone", "barrier": "barrier", "czone_sign": "sign", "generic_object": "object"}
#: The body of the recording vehicle, whose poses are those of its rear axle.
EGO_BODY = {"length_m": 5.176, "width_m": 2.297, "center_forward_m": 1.461}
_SLICE = re.compile(r"(.+)_(\d{5})_(\d{5})$")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SqliteSource(DataSource):
    """Options: paths (separated by new lines) and query, whose columns the schema names. Files are opened read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def reader(self, schema):
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.query, self.named = options["query"], schema

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            for row in db.execute(self.query):
                yield (partition.path, *row)
        finally:
            db.close()


def read(spark: SparkSession, paths: Sequence[str], query: str, schema: str) -> DataFrame:
    """The rows of a query on each file, with its path. The query's columns are those of the schema, in order."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_files").schema(f"path string, {schema}").options(paths="\n".join(map(str, paths)), query=query).load()


def session_name(paths: Sequence[str]) -> str:
    """One file's name; slices of one recording give it with their joint range; others are joined by + [SRC-08]."""
    stems = [re.sub(r"\.[^.]*$", "", str(p).rsplit("/", 1)[-1]) for p in sorted(paths, key=str)]
    found = [_SLICE.match(s) for s in stems]
    if len(stems) > 1 and all(found) and len({m[1] for m in found}) == 1:
        return f"{found[0][1]}_{found[0][2]}_{found[-1][3]}"
    return "+".join(stems)


def read_log(spark: SparkSession, paths: Sequence[str], object_interval_s: float = 0.45) -> dict[str, DataFrame]:
    """ego, objects, lights, tags, camera and meta of one session's files [SRC-07, JN-01, JN-02, ST-01].

    Files of different maps, or without a pose, are an error. Objects are kept at frames that lie object_interval_s
    apart; source times are micros.
    """
    name = session_name(paths)
    table = lambda query, schema: read(spark, paths, query, schema)
    versions = sorted(r[0] for r in table("select map_version from log", "map_version string").select("map_version").distinct().collect())
    if len(versions) != 1:
        raise ValueError(f"{name}: the files are of different maps: {versions}")
    session = F.lit(name).alias("session_id")
    nanos = (F.col("t") * 1000).alias("t_ns")
    pose = table("select timestamp, x, y, qw, qx, qy, qz, vx, angular_rate_z from ego_pose", "t long, x double, y double, qw double, qx double, qy double, qz double, vx double, wz double")
    ego = pose.select(session, nanos, "x", "y", scalars.quaternion_yaw(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).alias("yaw"), F.col("vx").alias("v"), F.col("wz").alias("yaw_rate"))
    if ego.isEmpty():
        raise ValueError(f"{name}: no poses")
    scan = table("select token, timestamp from lidar_pc", "pc binary, t long")
    box = table("select lidar_pc_token, track_token, x, y, yaw, vx, vy, confidence, length, width from lidar_box", "pc binary, track binary, x double, y double, yaw double, vx double, vy double, confidence double, length double, width double")
    track = table("select token, category_token from track", "track binary, category binary")
    category = table("select token, name from category", "category binary, category_name string")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    seen = box.join(scan, ["path", "pc"]).join(track, ["path", "track"]).join(category, ["path", "category"])
    seen = seen.select(
        session, nanos, F.coalesce(F.try_element_at(kinds, F.col("category_name")), F.lit("object")).alias("kind"), "x", "y", "yaw", F.hypot("vx", "vy").alias("speed"),
        F.coalesce("confidence", F.lit(1.0)).alias("existence"), F.hex("track").alias("track_id"), F.col("length").alias("length_m"), F.col("width").alias("width_m"),
    )
    kept = keep_apart(seen.select("session_id", "t_ns").distinct(), ["session_id"], "t_ns", int(object_interval_s * schemas.NS), strict=False)
    light = table("select lidar_pc_token, lane_connector_id, status from traffic_light_status", "pc binary, lane long, status string").join(scan, ["path", "pc"])
    tag = table("select lidar_pc_token, type from scenario_tag", "pc binary, kind string").join(scan, ["path", "pc"])
    image = table("select camera_token, timestamp, filename_jpg from image", "camera binary, t long, file string")
    front = table("select token, channel from camera", "camera binary, channel string").filter("channel = 'CAM_F0'")
    body = spark.createDataFrame([(name, versions[0], *EGO_BODY.values())], f"session_id string, location string, {', '.join(f'{k} double' for k in EGO_BODY)}")
    return {
        "ego": ego, "objects": seen.join(kept, ["session_id", "t_ns"], "left_semi"), "tags": tag.select(session, nanos, "kind"), "camera": image.join(front, ["path", "camera"]).select(session, nanos, "file"), "meta": body,
        "lights": light.groupBy(nanos).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("lane", "status")))).alias("lights")).select(session, "t_ns", "lights"),
    }


def image_poses(images: DataFrame, cameras: DataFrame, poses: DataFrame, image_camera: str = "camera_token", image_pose: str = "ego_pose_token", token: str = "token") -> DataFrame:
    """Images with the columns of their camera and of the ego's pose at capture, which get c_ and p_ [JN-03]. An image without either goes."""
    named = lambda df, prefix: df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
    c, p = named(cameras, "c_"), named(poses, "p_")
    return images.join(c, F.col(image_camera) == F.col(f"c_{token}")).join(p, F.col(image_pose) == F.col(f"p_{token}"))
