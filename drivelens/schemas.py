"""Explicit types of the shared tables. Times are integer nanoseconds since the epoch; nothing unknown has a default."""

from __future__ import annotations

from pyspark.sql import types as T

NS = 1_000_000_000
LATERAL = ("keep_lane", "turn_left", "turn_right", "u_turn", "lane_change_left", "lane_change_right", "branch_left", "branch_right", "avoidance", "pull_over", "pull_away")
LONGITUDINAL = ("stopped", "accelerating", "decelerating", "hard_braking", "cruising")
KEEP = "keep_lane"
UNKNOWN = "unknown"


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LONG, INT, DOUBLE, STRING, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
POINT = _struct(x=DOUBLE, y=DOUBLE)

EGO = _struct(session_id=STRING, t_ns=LONG, x=DOUBLE, y=DOUBLE, yaw=DOUBLE, v=DOUBLE, yaw_rate=DOUBLE)
OBJECT = _struct(kind=STRING, x=DOUBLE, y=DOUBLE, yaw=DOUBLE, speed=DOUBLE, existence=DOUBLE, track_id=STRING, length_m=DOUBLE, width_m=DOUBLE)
OBJECTS = _struct(session_id=STRING, t_ns=LONG, objs=T.ArrayType(OBJECT))
INDICATOR = _struct(session_id=STRING, t_ns=LONG, code=INT)
LIGHTS = _struct(session_id=STRING, t_ns=LONG, lights=T.MapType(LONG, STRING), light_ahead=STRING)
LANE = _struct(
    id=LONG, kind=STRING, turn_direction=STRING, left=LONG, left_crossable=BOOL, right=LONG, right_crossable=BOOL,
    following=T.ArrayType(LONG), previous=T.ArrayType(LONG), centerline=T.ArrayType(POINT), polygon=T.ArrayType(POINT), traffic_lights=T.ArrayType(LONG),
)
TIMELINE = _struct(session_id=STRING, i=INT, t_ns=LONG, valid=BOOL, x=DOUBLE, y=DOUBLE, yaw=DOUBLE, v=DOUBLE, accel=DOUBLE, jerk=DOUBLE, yaw_rate=DOUBLE)
STEP = _struct(
    session_id=STRING, t_ns=LONG, lateral=STRING, lateral_probs=T.MapType(STRING, DOUBLE), longitudinal=STRING, longitudinal_probs=T.MapType(STRING, DOUBLE),
    model=STRING, input_tokens=LONG, provider=STRING, cache_key=STRING,
)
PHASE = _struct(end_ns=LONG, decision=STRING)
SCENE = _struct(
    session_id=STRING, start_ns=LONG, end_ns=LONG, lateral=STRING, longitudinal=STRING, lateral_prob=DOUBLE, longitudinal_prob=DOUBLE, phases=T.ArrayType(PHASE),
)
#: A scene document as it is written: nanoseconds are decimal strings. Older ones have lateral and longitudinal instead of a decision and phases.
SCENE_ROW = _struct(start_ns=STRING, end_ns=STRING, driving_decision=STRING, longitudinal_phases=T.ArrayType(_struct(end_ns=STRING, decision=STRING)), lateral=STRING, longitudinal=STRING)
SCENE_DOCUMENT = _struct(session=STRING, start_ns=STRING, end_ns=STRING, scenes=T.ArrayType(SCENE_ROW))
