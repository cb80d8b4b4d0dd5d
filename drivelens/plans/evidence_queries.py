"""Queries on recorded messages, bodies over lanes and borders, words of lanes and the indicator, and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import body, camera, describe, geometry, lanes, objects, view
from ..sources import logs
from . import lift
from .lift import EVENTS, HOUR, NUMBERED, SESSION, candidate, events, micros, numbered, read, spans_sql
from .object_queries import BOXES, RELATIONS, boxes
from .registry import query

DAY = 24 * HOUR
FROM, TO = 725_846_400_000_000, 883_612_800_000_000


@query(
    "src02_chunks",
    f"""WITH c AS (SELECT o_custkey AS session_id, CAST(o_orderkey AS VARCHAR) AS path, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS start_ns, epoch_us(CAST(o_orderdate AS TIMESTAMP)) + (o_orderkey % 5) * {DAY} AS end_ns FROM orders)
    SELECT session_id, path, CAST(row_number() OVER (PARTITION BY session_id ORDER BY start_ns, path) - 1 AS INTEGER) AS place FROM c WHERE end_ns >= {FROM} AND start_ns <= {TO}""",
)
def src02(spark, sf):
    """Orders as chunks of their customer's log."""
    begin = micros("o_orderdate")
    chunks = read(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").cast("string").alias("path"), begin.alias("start_ns"), (begin + F.col("o_orderkey") % 5 * DAY).alias("end_ns"))
    return logs.chunks_between(chunks, FROM, TO).select("session_id", "path", "place")


@query(
    "src01_routed",
    f"""WITH {EVENTS}, m AS (SELECT sid, CASE label WHEN 'view' THEN 'ego' WHEN 'click' THEN 'indicator' END AS role, event_id % 9 <> 0 AS ok FROM ev WHERE label IN ('view', 'click'))
    SELECT sid AS session_id, count(*) FILTER (WHERE NOT ok) AS undecoded, concat_ws(',', CASE WHEN NOT bool_or(ok AND role = 'ego') THEN 'ego' END, CASE WHEN NOT bool_or(ok AND role = 'indicator') THEN 'indicator' END) AS missing FROM m GROUP BY sid""",
)
def src01(spark, sf):
    """Event types as topics; each ninth message can't be decoded."""
    messages = events(spark, sf).select(F.col("sid").alias("session_id"), F.col("t").alias("t_ns"), F.col("label").alias("topic"), F.when(F.col("event_id") % 9 != 0, F.col("v")).alias("message"))
    topics = spark.sql("SELECT * FROM VALUES ('ego', 'view'), ('indicator', 'click') AS t(role, topic)")
    return logs.reading_report(logs.routed(messages, topics), "message").withColumn("missing", F.array_join("missing", ","))


@query("src04_ego", "SELECT event_id AS t_ns, value AS x, user_id AS y, round(atan2(2 * cos(value / 100) * sin(value / 100), 1 - 2 * sin(value / 100) * sin(value / 100)), 6) AS yaw, value / 10 AS v, CAST(event_id % 7 AS DOUBLE) AS yaw_rate FROM events")
def src04(spark, sf):
    """Events as vehicle states of both shapes, by their id's parity."""
    e = read(spark, sf, "events")
    value, zero = F.col("value"), F.lit(0.0)
    named = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    pose = named(position=named(x=value, y=F.col("user_id")), orientation=named(w=F.cos(value / 100), x=zero, y=zero, z=F.sin(value / 100)))
    twist = named(linear=named(x=value / 10), angular=named(z=(F.col("event_id") % 7).cast("double")))

    def states(rest: int, deeper: bool):
        nest = (lambda name, part: named(**{name: named(**{name: part})})) if deeper else (lambda name, part: named(**{name: part}))
        rows = e.filter(F.col("event_id") % 2 == rest).select(F.lit("s").alias("session_id"), F.col("event_id").alias("t_ns"), named(pose=nest("pose", pose), twist=nest("twist", twist)).alias("message"))
        return logs.ego(rows)

    found = states(0, False).unionByName(states(1, True)).drop("session_id")
    return found.withColumn("yaw", F.round("yaw", 6))


@query(
    "src05_objects",
    """WITH p AS (SELECT *, CASE WHEN l_discount >= l_tax THEN l_linenumber * 2 ELSE l_suppkey % 13 END AS class FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(list_extract(['unknown', 'car', 'truck', 'bus', 'trailer', 'motorcycle', 'bicycle', 'pedestrian', 'animal', 'hazard', 'object', 'object'], CAST(class + 1 AS INTEGER)), 'unknown') AS kind,
      round(sqrt(l_tax * l_tax + l_discount * l_discount), 6) AS speed, CASE WHEN l_partkey % 3 <> 0 THEN lpad(lower(to_hex(l_partkey)), 16, '0') END AS track_id, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS length_m FROM p""",
)
def src05(spark, sf):
    """Line items as published objects with two classes; every third has an id of zeros, every second no length."""
    named = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    li, zero = read(spark, sf, "lineitem"), F.lit(0.0)
    classes = F.array(named(label=(F.col("l_linenumber") * 2).cast("int"), probability=F.col("l_discount")), named(label=(F.col("l_suppkey") % 13).cast("int"), probability=F.col("l_tax")))
    number = F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).otherwise(0)
    pose = named(pose=named(position=named(x=F.col("l_quantity"), y=zero), orientation=named(w=F.lit(1.0), x=zero, y=zero, z=zero)))
    shape = named(dimensions=named(x=F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).otherwise(0.0), y=zero))
    one = named(
        classification=classes, kinematics=named(initial_pose_with_covariance=pose, initial_twist_with_covariance=named(twist=named(linear=named(x=F.col("l_tax"), y=F.col("l_discount"))))),
        existence_probability=zero, object_id=named(uuid=F.unhex(F.lpad(F.hex(number), 16, "0"))), shape=shape,
    )
    rows = li.select("l_orderkey", "l_linenumber", F.array(one).alias("objects"))
    found = rows.withColumn("o", logs.detected(F.col("objects"), rows.schema["objects"].dataType)[0])
    return found.select("l_orderkey", "l_linenumber", "o.kind", F.round("o.speed", 6).alias("speed"), "o.track_id", "o.length_m")


@query("or16_session_ends", f"WITH {EVENTS} SELECT sid AS session_id, min(t) AS start_ns, max(t) AS end_ns FROM ev GROUP BY sid")
def or16(spark, sf):
    return logs.session_ends(events(spark, sf).select(F.col("sid").alias("session_id"), F.col("t").alias("t_ns")))


#: A straight lane and one that bends; its parts, as the SQL sums them.
LANES = {1: [(10, 2), (30, 2), (30, 6), (10, 6)], 2: [(0, 0), (20, 0), (20, 3), (5, 3), (5, 8), (0, 8)]}


def _shared_sql(x0: int, y0: int, x1: int, y1: int) -> str:
    return f"greatest(least(x + 2, {x1}) - greatest(x - 2, {x0}), 0) * greatest(least(y + w / 2, {y1}) - greatest(y - w / 2, {y0}), 0)"


@query(
    "jn12_occupied_lanes",
    f"WITH {BOXES}, s AS (SELECT frame, line, pos, 1 AS lane_id, {_shared_sql(10, 2, 30, 6)} AS a, w FROM bx UNION ALL SELECT frame, line, pos, 2, {_shared_sql(0, 0, 20, 3)} + {_shared_sql(0, 3, 5, 8)}, w FROM bx) SELECT frame, line, pos, lane_id, round(a / (4 * w), 6) AS fraction FROM s WHERE a > 1e-8",
)
def jn12(spark, sf):
    zero = F.lit(0.0)
    bodies = boxes(spark, sf).select("frame", "line", F.col("pos").cast("long").alias("pos"), geometry.rectangle_column(F.col("x"), F.col("y"), zero, F.lit(4.0), F.col("w")).alias("body"))
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in LANES.items()]
    table = spark.createDataFrame(rows, "id int, polygon array<struct<x:double,y:double>>")
    return body.occupied_lanes(bodies, table).withColumn("fraction", F.round("fraction", 6))


@query(
    "jn13_crossed_sides",
    f"WITH {BOXES}, o AS (SELECT frame, line, pos, y - w / 2 < 6.137 AND y + w / 2 > 6.137 AS l, y - w / 2 < 3.137 AND y + w / 2 > 3.137 AS r FROM bx) SELECT frame, line, pos, concat_ws(',', CASE WHEN l THEN 'left' END, CASE WHEN r THEN 'right' END) AS sides FROM o WHERE l OR r",
)
def jn13(spark, sf):
    """Two borders along the road in pieces of 5 m, and one across it, which doesn't count."""
    bodies = boxes(spark, sf).select("frame", "line", F.col("pos").cast("long").alias("pos"), "x", "y", F.lit(0.0).alias("yaw"), F.lit(4.0).alias("length"), F.col("w").alias("width"), F.col("x").alias("foot_x"), F.lit(4.5).alias("foot_y"), F.lit(1.0).alias("tx"), F.lit(0.0).alias("ty"))
    edges = [(5.0 * i - 10, y, 5.0 * i - 5, y) for i in range(14) for y in (3.137, 6.137)] + [(25.0, -20.0, 25.0, 30.0)]
    table = spark.createDataFrame(edges, "ax double, ay double, bx double, by double")
    return body.crossed_sides(bodies, table, ["frame", "line", "pos"]).withColumn("sides", F.array_join("sides", ","))


@query("ge08_centred_body", "WITH p AS (SELECT event_id, value AS x, CAST(user_id AS DOUBLE) AS y, CAST(event_id % 6 AS DOUBLE) AS h FROM events) SELECT event_id, round(x + 1.5 * cos(h) + 2 * cos(h) - sin(h), 6) AS x0, round(y + 1.5 * sin(h) + 2 * sin(h) + cos(h), 6) AS y0 FROM p")
def ge08(spark, sf):
    heading = (F.col("event_id") % 6).cast("double")
    outline = body.centred_body(F.col("value"), F.col("user_id").cast("double"), F.cos(heading), F.sin(heading), F.lit(4.0), F.lit(2.0), 1.5)
    return read(spark, sf, "events").select("event_id", F.round(outline[0]["x"], 6).alias("x0"), F.round(outline[0]["y"], 6).alias("y0"))


TURN = "CASE WHEN {0} % 4 = 0 THEN 'left' END"
KIND = "CASE WHEN {0} % 7 = 0 THEN 'shoulder' ELSE 'driving' END"


def _turn_kind(lane):
    return F.when(lane % 4 == 0, "left"), F.when(lane % 7 == 0, "shoulder").otherwise("driving")


@query(
    "fn14_transitions",
    f"""WITH {RELATIONS}, {NUMBERED[len('ev AS') - 5:]}, c AS (SELECT sid, i, CAST(k % 25 AS BIGINT) AS b, CAST(lag(k) OVER (PARTITION BY sid ORDER BY i) % 25 AS BIGINT) AS a FROM nu), x AS (SELECT sid, i, coalesce(relation, 'other') AS r, 'L' || a AS f, 'L' || b AS t, b FROM c LEFT JOIN rl USING (a, b) WHERE a <> b)
    SELECT sid, i, CASE WHEN r IN ('left', 'right') THEN 'moves from ' || f || ' into its ' || r || ' neighbor ' || t WHEN r IN ('following', 'near') THEN 'continues from ' || f || ' into ' || t || CASE WHEN b % 4 = 0 THEN ' (intersection lane, turn direction LEFT)' ELSE '' END
      WHEN r = 'previous' THEN 'moves back from ' || f || ' into ' || t ELSE 'moves from ' || f || ' into ' || t || ' (not directly connected)' END AS said FROM x""",
)
def fn14(spark, sf):
    track = numbered(spark, sf).select("sid", "i", (F.col("k") % 25).cast("long").alias("lane_id"))
    moved = lanes.lane_changes(track, lanes.relations(lift.lanes(spark, sf)), ["sid"], "i")
    name = lambda c: F.concat(F.lit("L"), F.col(c).cast("string"))
    turn, kind = _turn_kind(F.col("b"))
    return moved.select("sid", "i", describe.transition_text(F.col("relation"), name("a"), name("b"), kind, turn).alias("said"))


@query(
    "fn14_descriptions",
    f"""WITH {lift.LANES}, nm AS (SELECT DISTINCT c_custkey % 40 AS s, CAST(c_nationkey AS BIGINT) AS id FROM customer WHERE c_custkey % 3 = 0),
    tx AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'intersection lane, turn direction LEFT' ELSE {KIND.format('id')} END AS what, {KIND.format('id')} AS kind FROM ln),
    fo AS (SELECT id, unnest(CASE WHEN id % 3 = 0 THEN [(id + 5) % 25, (id + 7) % 25] ELSE [(id + 5) % 25] END) AS f, unnest(CASE WHEN id % 3 = 0 THEN [0, 1] ELSE [0] END) AS o FROM ln),
    ow AS (SELECT nm.s, nm.id, string_agg('L' || k.id, ', ' ORDER BY o) FILTER (WHERE k.id IS NOT NULL) AS named, string_agg(tx.what, ', ' ORDER BY tx.what) FILTER (WHERE k.id IS NULL) AS rest, count(*) FILTER (WHERE k.id IS NULL) AS n_rest, count(*) AS n, bool_or(f % 4 <> 0) AS open
      FROM nm JOIN fo ON fo.id = nm.id JOIN tx ON tx.id = f LEFT JOIN nm k ON k.s = nm.s AND k.id = f GROUP BY nm.s, nm.id),
    nb AS (SELECT nm.s, nm.id, l, r, a.id IS NOT NULL AS la, b.id IS NOT NULL AS ra, lt.kind AS lk, rt.kind AS rk FROM nm JOIN ln ON ln.id = nm.id LEFT JOIN nm a ON a.s = nm.s AND a.id = l LEFT JOIN nm b ON b.s = nm.s AND b.id = r LEFT JOIN tx lt ON lt.id = l LEFT JOIN tx rt ON rt.id = r)
    SELECT nb.s, nb.id AS lane_id, 'L' || nb.id || ': ' || tx.what
      || '; left neighbor: ' || CASE WHEN l IS NULL THEN 'none' ELSE CASE WHEN la THEN 'L' || l ELSE 'a ' || lk || ' lane' END || CASE WHEN nb.id % 2 = 0 THEN ' (dashed line, can be crossed)' ELSE ' (solid line)' END END
      || '; right neighbor: ' || CASE WHEN r IS NULL THEN 'none' ELSE CASE WHEN ra THEN 'L' || r ELSE 'a ' || rk || ' lane' END || ' (solid line)' END
      || '; leads into: ' || concat_ws(' and ', named, CASE WHEN n_rest > 0 THEN n_rest || ' other lane(s) (' || rest || ')' END)
      || CASE WHEN n >= 2 AND tx.kind <> 'shoulder' THEN CASE WHEN open THEN '; the road forks here' ELSE '; an intersection starts here' END ELSE '' END AS description
    FROM nb JOIN ow ON ow.s = nb.s AND ow.id = nb.id JOIN tx ON tx.id = nb.id""",
)
def fn14_descriptions(spark, sf):
    named = read(spark, sf, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") % 40).alias("s"), F.col("c_nationkey").cast("long").alias("lane_id")).distinct()
    named = named.withColumn("name", F.concat(F.lit("L"), F.col("lane_id").cast("string")))
    turn, kind = _turn_kind(F.col("id"))
    onward = F.when(F.col("id") % 3 == 0, F.array((F.col("id") + 5) % 25, (F.col("id") + 7) % 25)).otherwise(F.array((F.col("id") + 5) % 25))
    table = lift.lanes(spark, sf).select("id", "left", "right", kind.alias("kind"), turn.alias("turn_direction"), (F.col("id") % 2 == 0).alias("left_crossable"), F.lit(False).alias("right_crossable"), onward.alias("following"))
    return describe.lane_descriptions(named, table, ["s"])


SAID = """CASE WHEN {0} < 0 THEN 't=-' ELSE 't=+' END || CASE WHEN abs({0} / 1e5 - round_even({0} / 1e5, 0)) <= greatest(1e-9 * greatest(abs({0} / 1e5), abs(round_even({0} / 1e5, 0))), 1e-8) THEN printf('%.1f', abs({0} / 1e6)) ELSE printf('%.2f', abs({0} / 1e6)) END || 's'"""


@query(
    "ag25_indicator_text",
    f"""WITH {NUMBERED}, m AS (SELECT sid, t, event_id, CASE label WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS code FROM ev), g AS (SELECT *, lag(code, 1, 1) OVER (PARTITION BY sid ORDER BY t, event_id) AS b FROM m),
    st AS (SELECT sid, t AS s, coalesce(lead(t) OVER (PARTITION BY sid ORDER BY t, event_id), 9000000000000000) AS e, code FROM g WHERE code <> b),
    wi AS (SELECT sid, event_id, t, t - {36 * HOUR} AS lo, t + {24 * HOUR} AS hi FROM ev), ov AS (SELECT wi.sid, event_id, t, greatest(s, lo) AS a, least(e, hi) AS b, code FROM wi JOIN st ON st.sid = wi.sid AND s <= hi AND e > lo AND code <> 1),
    te AS (SELECT sid, event_id, a, b, CASE code WHEN 2 THEN 'LEFT' ELSE 'RIGHT' END || ' from ' || {SAID.format('(a - t)')} || ' to ' || {SAID.format('(b - t)')} AS x FROM ov)
    SELECT ev.sid, ev.event_id, coalesce(string_agg(x, '; ' ORDER BY a, b, x), 'never on (no LEFT or RIGHT)') AS indicator FROM ev LEFT JOIN te ON te.event_id = ev.event_id AND te.sid = ev.sid GROUP BY ev.sid, ev.event_id""",
)
def ag25(spark, sf):
    rows = events(spark, sf).select("sid", "event_id", (F.col("t") * 1000).alias("now"), F.when(F.col("label") == "click", 2).when(F.col("label") == "purchase", 3).otherwise(1).alias("code"))
    states = describe.indicator_states(rows, SESSION, "now", "code", ["event_id"])
    windows = rows.select("sid", "event_id", "now", (F.col("now") - 36_000 * HOUR).alias("lo"), (F.col("now") + 24_000 * HOUR).alias("hi"))
    return describe.indicator_text(windows, states, SESSION, "now", "lo", "hi", 48_000 * HOUR).select("sid", "event_id", "indicator")


@query("wn07_lane_trace", f"WITH {EVENTS}, w AS (SELECT event_id, k % 17 AS lo, k % 17 + k % 23 AS hi FROM ev) SELECT event_id, CAST(unnest(list_distinct(list_concat([lo, hi], [x FOR x IN range(lo, hi + 1) IF x % 5 = 0]))) AS INTEGER) AS i FROM w")
def wn07(spark, sf):
    windows = events(spark, sf).select("event_id", (F.col("k") % 17).alias("lo"), (F.col("k") % 17 + F.col("k") % 23).alias("hi"))
    return describe.lane_trace(windows, "lo", "hi").select("event_id", "i")


AHEAD, RIGHT = "(cos(h) * (x - 50) + sin(h) * (y - 20))", "(sin(h) * (x - 50) - cos(h) * (y - 20))"


@query("ge16_screen", f"WITH p AS (SELECT event_id, value AS x, user_id / 3.0 AS y, CAST(event_id % 6 AS DOUBLE) AS h FROM events) SELECT event_id, round(320 + {RIGHT} * 4, 6) AS px, round(480 * 0.65::DOUBLE - {AHEAD} * 4, 6) AS py, round(least(8, CASE WHEN {AHEAD} > 0 THEN 480 * 0.65::DOUBLE / ({AHEAD} + 6) END, CASE WHEN {AHEAD} < 0 THEN 480 * 0.35::DOUBLE / (6 - {AHEAD}) END, 320 / (abs({RIGHT}) + 6)), 6) AS scale FROM p")
def ge16(spark, sf):
    x, y, heading = F.col("value"), F.col("user_id") / 3.0, (F.col("event_id") % 6).cast("double")
    pose = (F.lit(50.0), F.lit(20.0), heading)
    px, py = view.screen_point(x, y, *pose, 640.0, 480.0, F.lit(4.0))
    scale = view.fit_scale(F.array(F.struct(x.alias("x"), y.alias("y"))), *pose, 640.0, 480.0, 8.0)
    return read(spark, sf, "events").select("event_id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.round(scale, 6).alias("scale"))


@query(
    "ge17_ribbon",
    f"""WITH {EVENTS}, {spans_sql('rn', 'ev', HOUR // 2, 'k >= 40')}, se AS (SELECT sid, t, min(event_id) AS id, arg_min(v, event_id) AS v, arg_min(k, event_id) AS k FROM ev GROUP BY sid, t),
    q AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lag(k) OVER w AS k0 FROM se WINDOW w AS (PARTITION BY sid ORDER BY t)), qu AS (SELECT * FROM q WHERE t0 < t AND k % 5 <> 0),
    mk AS (SELECT sid, t, t0 AS c FROM qu UNION SELECT qu.sid, qu.t, u.c FROM qu JOIN (SELECT sid, a AS c FROM rn UNION SELECT sid, b FROM rn) u ON u.sid = qu.sid AND u.c > qu.t0 AND u.c < qu.t),
    pc AS (SELECT mk.sid, mk.t, c AS s, lead(c, 1, mk.t) OVER (PARTITION BY mk.sid, mk.t ORDER BY c) AS e FROM mk)
    SELECT pc.sid, pc.t AS time, s AS start_us, e AS end_us, round(v0 + (v - v0) * ((s - t0) / CAST(pc.t - t0 AS DOUBLE)), 6) AS from_x, round(k0 - 1 + (k - k0) * ((e - t0) / CAST(pc.t - t0 AS DOUBLE)), 6) AS to_y, rn.label
    FROM pc JOIN qu ON qu.sid = pc.sid AND qu.t = pc.t LEFT JOIN rn ON rn.sid = pc.sid AND rn.a <= s AND s < rn.b""",
)
def ge17(spark, sf):
    """Events as sections of their session's ribbon, cut where the shifted runs begin or end."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    one = events(spark, sf).groupBy("sid", "t").agg(F.min_by(F.struct("v", "k"), "event_id").alias("e"))
    sections = one.select("sid", F.col("t").alias("time"), point(F.col("e.v"), F.col("e.k")).alias("left"), point(F.col("e.v") + 1, F.col("e.k") - 1).alias("right"), (F.col("e.k") % 5 != 0).alias("connect"))
    pieces = view.ribbon(sections, candidate(spark, sf), SESSION, 48 * HOUR)
    return pieces.select("sid", "time", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.round("from_left.x", 6).alias("from_x"), F.round("to_right.y", 6).alias("to_y"), "label")


@query(
    "wn27_anchors",
    f"""WITH {NUMBERED}, o AS (SELECT sid, i - 10 AS time_s, v AS c, (k % 10) / 10.0::DOUBLE AS s, i FROM nu), a AS (SELECT *, count(*) OVER w AS n, first_value(i) OVER (PARTITION BY sid ORDER BY abs(time_s), i) AS inow, first_value(i) OVER (PARTITION BY sid ORDER BY c, i) AS iclose, first_value(i) OVER (PARTITION BY sid ORDER BY s DESC, i) AS imost,
      min(CASE WHEN s > 0.01 THEN i END) OVER w AS i0, max(CASE WHEN s > 0.01 THEN i END) OVER w AS i1 FROM o WINDOW w AS (PARTITION BY sid)),
    r AS (SELECT sid, time_s, concat_ws(', ', CASE WHEN i = 0 THEN 'first observation' END, CASE WHEN i = n - 1 THEN 'last observation' END, CASE WHEN i = inow AND abs(time_s) <= 0.3 THEN 'NOW' END, CASE WHEN i = iclose THEN 'closest body passage' END, CASE WHEN i = imost THEN 'maximum overlap' END,
      CASE WHEN i = i0 THEN 'first observed overlap' END, CASE WHEN i = i1 THEN 'last observed overlap' END, CASE WHEN i = i0 - 1 THEN 'last clear before overlap' END, CASE WHEN i = i1 + 1 THEN 'first observed clear' END) AS reasons FROM a) SELECT * FROM r WHERE reasons <> ''""",
)
def wn27(spark, sf):
    """A session's events as observations of one object."""
    rows = numbered(spark, sf).select("sid", (F.col("i") - 10).alias("time_s"), F.col("v").alias("clearance"), ((F.col("k") % 10) / 10.0).alias("share"))
    return objects.anchors(rows, SESSION).select("sid", "time_s", F.array_join("reasons", ", ").alias("reasons"))


TENTH = 100_000_000


def _path(spark, sf):
    """A session's events as poses a tenth of a second apart, all of them images too."""
    n = numbered(spark, sf)
    turn, zero = F.col("k") / 2000, F.lit(0.0)
    values = {"x": F.col("i") * 0.8, "y": F.col("k") * 0.01, "z": zero, "qw": F.cos(turn), "qx": zero, "qy": zero, "qz": F.sin(turn)}
    return n.select(F.col("sid").alias("session_id"), (F.col("i").cast("long") * TENTH).alias("t_ns"), *[v.alias(c) for c, v in values.items()])


PATH = NUMBERED + f", po AS (SELECT sid AS session_id, CAST(i AS BIGINT) * {TENTH} AS t_ns, i * 0.8::DOUBLE AS x, k * 0.01::DOUBLE AS y, k / 1000.0::DOUBLE AS h FROM nu), en AS (SELECT session_id, max(t_ns) - {3 * TENTH} AS e FROM po GROUP BY 1)"
PAIRS = f"pa AS (SELECT a.session_id, a.t_ns, b.t_ns AS u, b.x - a.x AS dx, b.y - a.y AS dy, a.h, b.h AS g FROM po a JOIN en ON en.session_id = a.session_id JOIN po b ON b.session_id = a.session_id AND b.t_ns >= a.t_ns AND b.t_ns <= least(e, a.t_ns + {100 * TENTH}))"


def _images(spark, sf):
    poses = _path(spark, sf)
    ends = poses.groupBy("session_id").agg((F.max("t_ns") - 3 * TENTH).alias("end_ns"))
    return camera.future_poses(poses.withColumn("camera", F.lit("front")), poses, ends)


@query("or21_future_poses", f"WITH {PATH}, {PAIRS} SELECT po.session_id, po.t_ns, count(u) AS n, max(u) AS last_ns FROM po LEFT JOIN pa ON pa.session_id = po.session_id AND pa.t_ns = po.t_ns GROUP BY 1, 2")
def or21(spark, sf):
    return _images(spark, sf).select("session_id", "t_ns", F.size("future").cast("long").alias("n"), F.try_element_at("future", F.lit(-1))["t_ns"].alias("last_ns"))


CAMERA = {"translation": [1.5, 0.0, 1.6], "rotation": [0.5, -0.5, 0.5, -0.5], "intrinsic": [[500.0, 0.0, 320.0], [0.0, 500.0, 240.0], [0.0, 0.0, 1.0]]}


@query(
    "ge11_camera_path",
    f"""WITH {PATH}, {PAIRS}, s AS (SELECT *, -sin(g) AS nx, cos(g) AS ny FROM pa), e AS (SELECT session_id, t_ns, (u - t_ns) / 1e9::DOUBLE AS time_s, cos(h) * (dx + nx) + sin(h) * (dy + ny) - 1.5 AS la, cos(h) * (dy + ny) - sin(h) * (dx + nx) AS ll, cos(h) * (dx - nx) + sin(h) * (dy - ny) - 1.5 AS ra, cos(h) * (dy - ny) - sin(h) * (dx - nx) AS rl FROM s)
    SELECT session_id, t_ns, round(time_s, 3) AS time_s, round(320 - 500 * ll / la, 3) AS left_x, round(240 + 800 / la, 3) AS left_y, round(320 - 500 * rl / ra, 3) AS right_x FROM e WHERE la >= 1 AND ra >= 1""",
)
def ge11(spark, sf):
    """A path 2 m wide seen by a camera 1.6 m above the poses, without distortion."""
    found = camera.camera_paths(_images(spark, sf), {"front": CAMERA}, 2.0)
    return found.select("session_id", "t_ns", F.explode("sections").alias("s")).select("session_id", "t_ns", "s.time_s", "s.left_x", "s.left_y", "s.right_x")


ROADS = 6


@query(
    "flt07_heading_gate",
    f"""WITH {EVENTS}, p AS (SELECT event_id, CASE label WHEN 'view' THEN 'pedestrian' WHEN 'error' THEN NULL ELSE 'car' END AS kind, k * 0.2::DOUBLE AS y, radians((event_id % 14) * 25.0::DOUBLE + 1) AS yaw FROM ev), w AS (SELECT *, yaw + pi() - floor((yaw + pi()) / (2 * pi())) * 2 * pi() - pi() AS h FROM p)
    SELECT event_id, CAST(l AS BIGINT) AS lane_id FROM w CROSS JOIN (SELECT unnest(range({ROADS})) AS l) WHERE abs(y - l * 3.5) <= 1.01 AND (kind IS DISTINCT FROM 'car' OR abs(h) <= radians(60))""",
)
def flt07(spark, sf):
    """Events as objects between straight lanes."""
    kind = F.when(F.col("label") == "view", "pedestrian").when(F.col("label") != "error", "car")
    poses = events(spark, sf).select(F.col("event_id").alias("pose_id"), kind.alias("kind"), F.lit(0.0).alias("x"), (F.col("k") * 0.2).alias("y"), F.radians((F.col("event_id") % 14) * 25.0 + 1).alias("yaw"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    table = spark.range(ROADS).select("id", F.array(point(-30.0, F.col("id") * 3.5), point(50.0, F.col("id") * 3.5)).alias("centerline"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("polygon"))
    return lanes.lanes_of_objects(poses, table, 1.01).select(F.col("pose_id").alias("event_id"), "lane_id")


@query("src03_topics", "WITH a AS (SELECT DISTINCT event_type AS topic FROM events), p(role, rank, topic) AS (VALUES ('ego', 0, 'missing'), ('ego', 1, 'view'), ('ego', 2, 'click'), ('indicator', 0, 'click'), ('objects', 0, 'none'), ('lights', 1, 'error'), ('lights', 2, 'view')) SELECT role, arg_min(topic, rank) AS topic FROM p JOIN a USING (topic) GROUP BY role")
def src03(spark, sf):
    from ..sources.documents import chosen_topics

    wanted = spark.sql("SELECT * FROM VALUES ('ego', 0, 'missing'), ('ego', 1, 'view'), ('ego', 2, 'click'), ('indicator', 0, 'click'), ('objects', 0, 'none'), ('lights', 1, 'error'), ('lights', 2, 'view') AS t(role, rank, topic)")
    return chosen_topics(read(spark, sf, "events").select(F.col("event_type").alias("topic")), wanted)


@query("ge03_joined_line", "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 20 AS g FROM embeddings) SELECT vec_id, CASE WHEN abs(g) > 5 THEN 2 ELSE 3 END AS points, round(CASE WHEN abs(g) > 5 THEN 10 ELSE 10 + g / 2 END, 6) AS second_x FROM p")
def ge03(spark, sf):
    """Two straight lanes in line, apart or overlapping by a component."""
    import numpy as np
    import pandas as pd

    gap = F.col("embedding")[0].cast("double") * 20
    rows = read(spark, sf, "embeddings").select("vec_id", gap.alias("g"))

    def run(batches):
        for part in batches:
            found = [geometry.joined_line([np.array([(0.0, 0.0), (10.0, 0.0)]), np.array([(10.0 + g, 0.0), (40.0, 0.0)])]) for g in part["g"]]
            yield pd.DataFrame({"vec_id": part["vec_id"], "points": [len(f) for f in found], "second_x": [round(float(f[1, 0]), 6) for f in found]})

    return rows.mapInPandas(run, "vec_id long, points int, second_x double")


@query(
    "wn23_rule_steps",
    f"""WITH {NUMBERED}, lo AS (SELECT *, coalesce(lead(v, 100) OVER w, last_value(v) OVER f) - coalesce(lag(v, 100) OVER w, first_value(v) OVER f) AS g FROM nu WINDOW w AS (PARTITION BY sid ORDER BY i), f AS (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    st AS (SELECT sid, i, CASE WHEN v < 0.3 THEN 'stopped' WHEN k < 10 THEN 'hard_braking' WHEN g > 1 THEN 'accelerating' WHEN g < -1 THEN 'decelerating' ELSE 'cruising' END AS longitudinal FROM lo WHERE k >= 3),
    sp AS (SELECT sid, i * 0.02::DOUBLE - 0.05 AS a, i * 0.02::DOUBLE + 0.09 AS b, label, k % 2 AS kind, i AS p FROM nu WHERE label IN ('click', 'purchase')),
    hi AS (SELECT st.sid, st.i, arg_min(label, struct_pack(x := kind, y := p)) AS held FROM st JOIN sp ON sp.sid = st.sid AND a <= st.i * 0.02::DOUBLE AND b >= st.i * 0.02::DOUBLE GROUP BY 1, 2)
    SELECT st.sid AS session_id, CAST(st.i AS BIGINT) * 20000000 AS t_ns, coalesce(held, 'keep_lane') AS "lateral", longitudinal FROM st LEFT JOIN hi ON hi.sid = st.sid AND hi.i = st.i""",
)
def wn23(spark, sf):
    """Events as samples 20 ms apart; clicks and purchases as spans of the rules."""
    from . import rules

    n = numbered(spark, sf)
    timeline = n.select(F.col("sid").alias("session_id"), "i", (F.col("i").cast("long") * 20_000_000).alias("t_ns"), (F.col("k") >= 3).alias("valid"), "v", (F.col("k") / 10.0 - 4).alias("accel"))
    at = F.col("i") * 0.02
    held = n.filter("label in ('click', 'purchase')").select(F.col("sid").alias("session_id"), (at - 0.05).alias("start"), (at + 0.09).alias("end"), "label", F.struct((F.col("k") % 2).alias("kind"), F.col("i").alias("k")).alias("priority"))
    return rules.rule_steps(timeline, held, timeline.select("session_id", "t_ns")).select("session_id", "t_ns", "lateral", "longitudinal")


@query("snk02_documents", f"WITH {EVENTS}, {spans_sql('gt', 'ev')} SELECT CAST(sid AS VARCHAR) AS session_id, CAST(a * 1000 AS VARCHAR) AS start_ns, CAST(b * 1000 AS VARCHAR) AS end_ns, label AS driving_decision FROM gt")
def snk02(spark, sf):
    """Scenes written as documents and read again."""
    from ..operators import stitch
    from ..sources.documents import read_written, write_documents
    from .library_queries import _folder

    found = lift.truth(spark, sf).select(F.col("sid").cast("string").alias("session_id"), (F.col("start") * 1000).alias("start_ns"), (F.col("end") * 1000).alias("end_ns"), F.col("label").alias("lateral"))
    listed = found.withColumns({"phases": F.array(F.struct("end_ns", F.lit("cruising").alias("decision"))), "lateral_prob": F.lit(1.0), "longitudinal_prob": F.lit(1.0)})
    sessions = found.groupBy("session_id").agg(F.min("start_ns").alias("session_start"), F.max("end_ns").alias("session_end"))
    path = _folder(spark)
    write_documents(stitch.session_documents(listed, sessions), path)
    return read_written(spark, path).select("session_id", F.explode("scenes").alias("s")).select("session_id", "s.start_ns", "s.end_ns", "s.driving_decision")


REVIEWED = f"rv AS (SELECT sid, min(t) + {DAY} AS s, min(t) + {4 * DAY} AS e FROM ev WHERE sid % 3 = 0 GROUP BY sid), bo AS (SELECT ev.sid AS session_id, event_id, v, k, CASE WHEN s IS NULL THEN 'none' WHEN t BETWEEN s AND e THEN 'core' WHEN t BETWEEN s - {DAY // 2} AND e + {DAY // 2} THEN 'margin' ELSE 'none' END AS state FROM ev LEFT JOIN rv ON rv.sid = ev.sid)"


def _bodies(spark, sf):
    """Events as bodies; every third session has a review of three days."""
    from ..operators import review

    e = events(spark, sf).select(F.col("sid").alias("session_id"), F.col("t").alias("t_ns"), "event_id", F.col("v").alias("margin_m"), F.col("k").alias("lane"))
    reviews = e.filter("session_id % 3 = 0").groupBy("session_id").agg((F.min("t_ns") + DAY).alias("start"), (F.min("t_ns") + 4 * DAY).alias("end")).withColumns({"margin": F.lit(DAY // 2), "chain_id": F.lit("P1"), "source": F.lit("camera")})
    return review.reviewed_bodies(e, reviews, kept=("event_id",))


@query("or06_reviewed_bodies", f"WITH {EVENTS}, {REVIEWED} SELECT session_id, event_id, CASE WHEN state = 'none' THEN v END AS margin_m, CASE state WHEN 'core' THEN 'P1' END AS physical_lane_chain, CASE WHEN state <> 'none' THEN 'camera' END AS lane_evidence_source FROM bo")
def or06(spark, sf):
    return _bodies(spark, sf).select("session_id", "event_id", "margin_m", "physical_lane_chain", "lane_evidence_source")


@query("ag23_preparation", f"WITH {EVENTS}, {REVIEWED} SELECT session_id, count(*) AS samples, count(*) FILTER (WHERE state = 'core') AS reviewed, CAST(coalesce(sum(length(CAST(k AS VARCHAR))) FILTER (WHERE state = 'none'), 0) AS BIGINT) AS chars, CAST(sum(length(CAST(event_id AS VARCHAR))) AS BIGINT) AS previous_chars FROM bo GROUP BY session_id")
def ag23(spark, sf):
    from ..operators import review

    rows = _bodies(spark, sf).withColumn("script", F.col("lane").cast("string")).withColumn("previous", F.col("event_id").cast("string"))
    return review.preparation_report(rows)
