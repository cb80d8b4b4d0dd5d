"""Recorded messages, decoded but nested as they were published, turned into the shared tables.

A chunk is a file of messages with its first and last time. Messages: session_id, t_ns, topic and the message itself;
one that could not be decoded is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hex_id, quaternion_yaw, speed

#: Kinds of objects by the number of their class.
OBJECT_KINDS = {0: "unknown", 1: "car", 2: "truck", 3: "bus", 4: "trailer", 5: "motorcycle", 6: "bicycle", 7: "pedestrian", 8: "animal", 9: "hazard", 10: "object", 11: "object"}


def chunks_between(chunks: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chunks that reach into [start, end], both ends included, with their place in order of their first time [SRC-02].

    chunks: session_id, path, start_ns, end_ns. Ties go by path. An end that is None is open.
    """
    kept = chunks
    if start is not None:
        kept = kept.filter(F.col("end_ns") >= start)
    if end is not None:
        kept = kept.filter(F.col("start_ns") <= end)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("start_ns", "path")) - 1)


def routed(messages: DataFrame, topics: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Messages of the chosen topics within [start, end], with their role [SRC-01]. topics: role, topic, a few rows."""
    kept = messages
    if start is not None:
        kept = kept.filter(F.col("t_ns") >= start)
    if end is not None:
        kept = kept.filter(F.col("t_ns") <= end)
    return kept.join(topics.select("role", "topic"), "topic")


def reading_report(found: DataFrame, message: str, required: tuple[str, ...] = ("ego", "indicator")) -> DataFrame:
    """session_id, undecoded, missing: messages that could not be decoded are counted, required roles without a decoded one are named, sorted [SRC-01].

    found: session_id, role and the message, as `routed` gives them.
    """
    decoded = F.col(message).isNotNull()
    have = F.collect_set(F.when(decoded, F.col("role")))
    wanted = F.array(*[F.lit(r) for r in sorted(required)])
    return found.groupBy("session_id").agg(F.count_if(~decoded).alias("undecoded"), F.array_sort(F.array_except(wanted, have)).alias("missing"))


def _has(kind: T.DataType, *path: str) -> bool:
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
    return True


def ego(messages: DataFrame, message: str = "message") -> DataFrame:
    """session_id, t_ns, x, y, yaw, v, yaw_rate of vehicle states; some types nest pose and twist one level deeper [SRC-04]."""
    deeper = _has(messages.schema[message].dataType, "pose", "pose", "pose")
    part = lambda name: F.col(".".join([message, *[name] * (3 if deeper else 2)]))
    pose, twist = part("pose"), part("twist")
    turn = pose["orientation"]
    return messages.filter(F.col(message).isNotNull()).select(
        "session_id", "t_ns", pose["position"]["x"].alias("x"), pose["position"]["y"].alias("y"), quaternion_yaw(turn["w"], turn["x"], turn["y"], turn["z"]).alias("yaw"), twist["linear"]["x"].alias("v"), twist["angular"]["z"].alias("yaw_rate")
    )


def likeliest(classes: Column) -> Column:
    """The kind of the most probable class, the first of equals; unknown without one or for an unlisted number. classes: array<struct<label, probability>>."""
    placed = F.transform(classes, lambda c, i: F.struct(c["probability"].alias("p"), (-i).alias("i"), c["label"].cast("int").alias("label")))
    names = F.create_map(*[F.lit(v) for pair in OBJECT_KINDS.items() for v in pair])
    best = F.array_max(placed)["label"]
    return F.coalesce(F.when(best.isNotNull(), F.try_element_at(names, best)), F.lit("unknown"))


def detected(objects: Column, kind: T.ArrayType) -> Column:
    """array of the shared object type for an array of published objects, whose type says which fields there are [SRC-05].

    Poses and twists come from the tracked fields, else from the predicted ones. Ids of zeros, sizes that are not
    positive and fields that the type lacks are null.
    """
    element = kind.elementType

    def first(o: Column, name: str) -> Column:
        named = [n for n in (f"{name}_with_covariance", f"initial_{name}_with_covariance") if _has(element, "kinematics", n)]
        return F.coalesce(*[o["kinematics"][n] for n in named])[name]

    def size(o: Column, axis: str) -> Column:
        if not _has(element, "shape", "dimensions", axis):
            return F.lit(None).cast("double")
        value = o["shape"]["dimensions"][axis]
        return F.when((value > 0) & ~F.isnan(value), value)

    def one(o: Column) -> Column:
        pose, twist = first(o, "pose"), first(o, "twist")
        turn = pose["orientation"]
        track = hex_id(o["object_id"]["uuid"]) if _has(element, "object_id", "uuid") else F.lit(None).cast("string")
        return F.struct(
            likeliest(o["classification"]).alias("kind"), pose["position"]["x"].alias("x"), pose["position"]["y"].alias("y"), quaternion_yaw(turn["w"], turn["x"], turn["y"], turn["z"]).alias("yaw"),
            speed(twist["linear"]["x"], twist["linear"]["y"]).alias("speed"), o["existence_probability"].alias("existence"), track.alias("track_id"), size(o, "x").alias("length_m"), size(o, "y").alias("width_m"),
        )

    return F.transform(objects, one)


def session_ends(ego_rows: DataFrame) -> DataFrame:
    """session_id, start_ns, end_ns: the first and the last vehicle state [OR-16]."""
    return ego_rows.groupBy("session_id").agg(F.min("t_ns").alias("start_ns"), F.max("t_ns").alias("end_ns"))


def object_interval(step_s: float) -> float:
    """Seconds between the object messages that are kept, for moments step_s apart [SRC-21]."""
    return min(0.45, 0.9 * step_s)
