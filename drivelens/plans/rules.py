"""The rule baseline: maneuvers from matched lanes and speeds, without a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import lanes, series, stitch
from ..operators.asof import grid_index
from ..operators.intervals import number_runs

#: Metres of lead and of measuring a turn, degrees of a turn and of a u-turn, seconds of its tail and around a lane change.
LEAD_M, MEASURE_M, TURN_DEG, U_TURN_DEG, TAIL_S, CHANGE_S = 30.0, 20.0, 40.0, 135.0, 2.0, 2.5
CELL_S = 16


def lateral_spans(track: DataFrame, lane_table: DataFrame, edges: DataFrame, keys: Sequence[str] = ("session_id",), cadence: float = 0.1) -> DataFrame:
    """keys, start and end in seconds of the track, label and priority of turns and lane changes [WN-21].

    track: keys, k, lane_id, x, y, yaw (unwrapped). A turn is a run on a lane that turns, with enough change of heading
    between MEASURE_M of path before and after it. Turns come before lane changes.
    """
    keys = list(keys)
    path = series.path_length(track, "x", "y", keys, "k", "s")
    named = path.join(lane_table.select(F.col("id").alias("lane_id"), "turn_direction"), "lane_id", "left")
    runs = number_runs(named, keys, ["k"], "lane_id")
    turning = runs.filter(F.col("turn_direction").isin("left", "right", "u-turn")).groupBy(*keys, "run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    total = path.groupBy(*keys).agg(F.max("k").alias("last"))
    # first place whose path length is not below a mark, for three marks of each turn: a merge of both, ordered by length
    marks = turning.select(*keys, "run", F.explode(F.array(*[F.struct(F.lit(n).alias("mark"), v.alias("s")) for n, v in (("before", F.col("s0") - MEASURE_M), ("after", F.col("s1") + MEASURE_M), ("lead", F.col("s0") - LEAD_M))])).alias("m")).select(*keys, "run", "m.*")
    stream = marks.withColumn("side", F.lit(0)).unionByName(path.select(*keys, "s", "k", "yaw", F.lit(1).alias("side")), allowMissingColumns=True)
    onward = Window.partitionBy(*keys).orderBy("s", "side", "k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = stream.withColumn("at", F.first(F.when(F.col("side") == 1, F.struct("k", "yaw")), ignorenulls=True).over(onward)).filter("side = 0").join(total, keys)
    ends = path.join(total, keys).filter("k = last").select(*keys, F.col("yaw").alias("last_yaw"))
    placed = found.join(ends, keys).select(*keys, "run", "mark", F.coalesce("at.k", "last").alias("k"), F.coalesce("at.yaw", "last_yaw").alias("yaw"))
    wide = placed.groupBy(*keys, "run").agg(*[F.max(F.when(F.col("mark") == m, F.col(c))).alias(f"{m}_{c}") for m in ("before", "after", "lead") for c in ("k", "yaw")])
    change = F.degrees(F.col("after_yaw") - F.col("before_yaw"))
    label = F.when(F.abs(change) > U_TURN_DEG, "u_turn").when(change > 0, "turn_left").otherwise("turn_right")
    turns = turning.join(wide, [*keys, "run"]).filter(F.abs(change) >= TURN_DEG).select(*keys, (F.col("lead_k") * cadence).alias("start"), (F.col("k1") * cadence + TAIL_S).alias("end"), label.alias("label"), F.struct(F.lit(0).alias("kind"), F.col("k0").alias("k")).alias("priority"))
    moved = lanes.lane_changes(track, edges, keys, "k").filter(F.col("relation").isin("left", "right"))
    changes = moved.select(*keys, (F.col("k") * cadence - CHANGE_S).alias("start"), (F.col("k") * cadence + CHANGE_S).alias("end"), F.concat(F.lit("lane_change_"), "relation").alias("label"), F.struct(F.lit(1).alias("kind"), F.col("k").alias("k")).alias("priority"))
    return turns.unionByName(changes)


def rule_steps(timeline: DataFrame, spans: DataFrame, times: DataFrame, step: int = 20_000_000) -> DataFrame:
    """Steps at the given times (session_id, t_ns) with probabilities of 1 [WN-22, WN-23]; times without valid motion are left out."""
    speeds = series.longitudinal(timeline, ["session_id"], "i", "v", "accel", 100)
    start = timeline.filter("i = 0").select("session_id", F.col("t_ns").alias("t0"))
    placed = times.join(start, "session_id").withColumn("i", grid_index(F.col("t_ns"), F.col("t0"), step).cast("int")).withColumn("at", (F.col("t_ns") - F.col("t0")) / schemas.NS)
    rows = placed.join(speeds.filter("valid").select("session_id", "i", "longitudinal"), ["session_id", "i"])
    # each time lies in one cell, each span in the few that it covers
    cell = lambda at: F.floor(F.col(at) / CELL_S).cast("long")
    near = spans.withColumn("cell", F.explode(F.sequence(cell("start"), F.greatest(cell("start"), cell("end")))))
    held = rows.withColumn("cell", cell("at")).join(near, ["session_id", "cell"]).filter((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end"))).groupBy("session_id", "t_ns").agg(F.min(F.struct("priority", "label"))["label"].alias("lateral"))
    out = rows.join(held, ["session_id", "t_ns"], "left").withColumn("lateral", F.coalesce("lateral", F.lit(schemas.KEEP)))
    return out.select("session_id", "t_ns", "lateral", F.create_map("lateral", F.lit(1.0)).alias("lateral_probs"), "longitudinal", F.create_map("longitudinal", F.lit(1.0)).alias("longitudinal_probs"))


def rule_scenes(timeline: DataFrame, track: DataFrame, lane_table: DataFrame, times: DataFrame, sessions: DataFrame, step_s: float, min_scene_s: float) -> DataFrame:
    """Scenes of the rules."""
    spans = lateral_spans(track, lane_table, lanes.relations(lane_table))
    return stitch.stitch(rule_steps(timeline, spans, times), sessions, step_s, min_scene_s)
