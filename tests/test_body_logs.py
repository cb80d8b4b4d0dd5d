import math

import numpy as np
from pyspark.sql import functions as F

from drivelens.functions import scalars
from drivelens.operators import body, camera, describe, geometry, objects, review, view
from drivelens.sources import logs

S = 1_000_000_000


def _star(rng, n):
    """A simple polygon that is concave as a rule: corners by angle at random distances."""
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    away = rng.uniform(1, 8, n)
    return np.stack([away * np.cos(angle), away * np.sin(angle)], 1)


def test_shared_areas_match_single_clips():
    rng = np.random.default_rng(5)
    for turn in (1, -1):
        for _ in range(20):
            lane = _star(rng, 9)[::turn]
            bodies = np.array([geometry.rectangle(*rng.uniform(-6, 6, 2), rng.uniform(-3, 3), *rng.uniform(0.5, 6, 2)) for _ in range(30)])
            plain = [abs(geometry.area(geometry.clip(lane, b))) for b in bodies]
            assert np.allclose(geometry.shared_areas(lane, bodies), plain, atol=1e-9)
            assert np.allclose(geometry.shared_areas(lane, bodies[:, ::-1]), plain, atol=1e-9)


def test_occupied_lanes_match_brute_force(spark):
    rng = np.random.default_rng(8)
    polygons = {i: _star(rng, 8) + rng.uniform(-60, 60, 2) for i in range(25)}
    poses = [(k, *map(float, rng.uniform(-60, 60, 2)), float(rng.uniform(-3, 3))) for k in range(120)]
    outline = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    bodies = spark.createDataFrame([(k, outline(geometry.rectangle(x, y, yaw, 4.5, 2.0))) for k, x, y, yaw in poses] + [(999, None)], "k long, body array<struct<x:double,y:double>>")
    table = spark.createDataFrame([(i, outline(p)) for i, p in polygons.items()] + [(99, None)], "id long, polygon array<struct<x:double,y:double>>")
    got = {(r["k"], r["lane_id"]): r["fraction"] for r in body.occupied_lanes(bodies, table, 7.0).collect()}
    want = {}
    for k, x, y, yaw in poses:
        box = geometry.rectangle(x, y, yaw, 4.5, 2.0)
        for i, p in polygons.items():
            if (a := abs(geometry.area(geometry.clip(p, box)))) > body.LEAST_AREA:
                want[k, i] = a / 9.0
    assert want and got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert body.occupied_lanes(bodies.limit(0), table).count() == 0


def test_border_inside_matches_sampling(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, (*rng.uniform(-6, 6, 4), *rng.uniform(-2, 2, 2), rng.uniform(-3, 3), *rng.uniform(1, 6, 2)))) for _ in range(60)] + [(-9.0, 1.0, 9.0, 1.0, 0.0, 0.0, 0.0, 4.0, 2.0), (0.0, -9.0, 0.0, 9.0, 0.0, 0.0, 0.0, 4.0, 2.0), (1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 4.0, 4.0)]
    names = ["ax", "ay", "bx", "by", "x", "y", "yaw", "length", "width"]
    got = spark.createDataFrame(rows, names).select(body.border_inside(*[F.col(c) for c in names]).alias("m")).collect()
    for (ax, ay, bx, by, x, y, yaw, length, width), r in zip(rows, got, strict=True):
        u = (np.arange(20000) + 0.5) / 20000
        dx, dy = ax + u * (bx - ax) - x, ay + u * (by - ay) - y
        inside = (np.abs(math.cos(yaw) * dx + math.sin(yaw) * dy) <= length / 2) & (np.abs(math.cos(yaw) * dy - math.sin(yaw) * dx) <= width / 2)
        assert abs(r["m"] - inside.mean() * math.hypot(bx - ax, by - ay)) < 0.01


def test_crossed_sides_ignore_edges_across(spark):
    body_columns = "k int, x double, y double, yaw double, length double, width double, foot_x double, foot_y double, tx double, ty double"
    bodies = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 4.0, 2.0, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 4.0, 2.0, 0.0, 0.0, 1.0, 0.0), (3, 40.0, 0.0, 0.0, 4.0, 2.0, 40.0, 0.0, 1.0, 0.0)], body_columns)
    edges = spark.createDataFrame([(-90.0, 1.75, 90.0, 1.75), (-90.0, -1.75, 90.0, -1.75), (40.0, -9.0, 40.0, 9.0)], "ax double, ay double, bx double, by double")
    assert [tuple(r) for r in body.crossed_sides(bodies, edges, ["k"]).collect()] == [(1, ["left"])]


def test_chunks_and_roles(spark):
    chunks = spark.createDataFrame([("s", "b", 10, 20), ("s", "a", 10, 12), ("s", "c", 30, 40), ("s", "d", 0, 9)], "session_id string, path string, start_ns long, end_ns long")
    assert [(r["path"], r["place"]) for r in logs.chunks_between(chunks, 10, 30).orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert logs.chunks_between(chunks).count() == 4
    messages = spark.createDataFrame([("s", 1, "/e", 1.0), ("s", 2, "/e", None), ("s", 3, "/i", None), ("s", 9, "/i", 2.0), ("s", 2, "/x", 1.0)], "session_id string, t_ns long, topic string, message double")
    topics = spark.createDataFrame([("ego", "/e"), ("indicator", "/i")], "role string, topic string")
    report = lambda end: logs.reading_report(logs.routed(messages, topics, 1, end), "message").collect()[0]
    assert (report(5)["undecoded"], report(5)["missing"]) == (2, ["indicator"])
    assert report(9)["missing"] == []
    assert logs.object_interval(1.0) == 0.45 and math.isclose(logs.object_interval(0.2), 0.18)


def test_detected_objects(spark):
    schema = """objects array<struct<classification:array<struct<label:int,probability:double>>,
      kinematics:struct<pose_with_covariance:struct<pose:struct<position:struct<x:double,y:double>,orientation:struct<w:double,x:double,y:double,z:double>>>,initial_pose_with_covariance:struct<pose:struct<position:struct<x:double,y:double>,orientation:struct<w:double,x:double,y:double,z:double>>>,
        twist_with_covariance:struct<twist:struct<linear:struct<x:double,y:double>>>>,
      existence_probability:double,object_id:struct<uuid:binary>,shape:struct<dimensions:struct<x:double,y:double>>>>"""
    pose = lambda x: {"pose": {"position": {"x": x, "y": 0.0}, "orientation": {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0}}}
    make = lambda classes, raw, length, tracked: {"classification": classes, "kinematics": {"pose_with_covariance": pose(1.0) if tracked else None, "initial_pose_with_covariance": pose(2.0), "twist_with_covariance": {"twist": {"linear": {"x": 3.0, "y": 4.0}}}}, "existence_probability": 0.5, "object_id": {"uuid": bytearray(raw)}, "shape": {"dimensions": {"x": length, "y": math.nan}}}
    tie = [{"label": 1, "probability": 0.5}, {"label": 7, "probability": 0.5}]
    rows = spark.createDataFrame([([make(tie, b"\x01\x00", 4.0, True), make([], b"\x00\x00", 0.0, False), make([{"label": 77, "probability": 1.0}], b"\x00\xab", -1.0, True)],), ([],)], schema)
    found = rows.select(logs.detected(F.col("objects"), rows.schema["objects"].dataType).alias("o")).collect()
    assert [(o["kind"], o["x"], o["speed"], o["track_id"], o["length_m"], o["width_m"]) for o in found[0]["o"]] == [("car", 1.0, 5.0, "0100", 4.0, None), ("unknown", 2.0, 5.0, None, None, None), ("unknown", 1.0, 5.0, "00ab", None, None)]
    assert found[1]["o"] == []


def test_indicator_text(spark):
    messages = spark.createDataFrame([("s", 0, 1), ("s", 2 * S, 2), ("s", 3 * S, 2), ("s", 5 * S + S // 4, 3), ("s", 7 * S, 1), ("s", 9 * S, 3)], "sid string, t long, code int")
    states = describe.indicator_states(messages, ["sid"], "t", "code")
    windows = spark.createDataFrame([("s", 4 * S, 0, 8 * S), ("s", S, 0, S), ("s", 2 * S, 0, 2 * S), ("s", 9 * S, 8 * S, 20 * S), ("u", S, 0, 9 * S)], "sid string, now long, lo long, hi long")
    out = describe.indicator_text(windows, states, ["sid"], "now", "lo", "hi", 3 * S, recorded=F.col("sid") == "s")
    got = {(r["sid"], r["now"] // S): r["indicator"] for r in out.collect()}
    never = "never on (no LEFT or RIGHT)"
    assert got == {("s", 4): "LEFT from t=-2.0s to t=+1.25s; RIGHT from t=+1.25s to t=+3.0s", ("s", 1): never, ("s", 2): "LEFT from t=+0.0s to t=+0.0s", ("s", 9): "RIGHT from t=+0.0s to t=+11.0s", ("u", 1): "not recorded in this log"}


def test_lane_descriptions_of_lanes_without_links(spark):
    table = spark.createDataFrame(
        [(1, "driving", None, None, False, 2, True, [3, 4]), (2, "shoulder", None, 1, True, None, False, [3, 9]), (3, "driving", "right", None, False, None, False, []), (4, "driving", "left", None, False, None, False, None)],
        "id long, kind string, turn_direction string, left long, left_crossable boolean, right long, right_crossable boolean, following array<long>",
    )
    named = spark.createDataFrame([("a", 1, "A"), ("a", 3, "C"), ("b", 2, "B"), ("b", 4, "D")], "s string, lane_id long, name string")
    got = {(r["s"], r["lane_id"]): r["description"] for r in describe.lane_descriptions(named, table, ["s"]).collect()}
    assert got["a", 1] == "A: driving; left neighbor: none; right neighbor: a shoulder lane (dashed line, can be crossed); leads into: C and 1 other lane(s) (intersection lane, turn direction LEFT); an intersection starts here"
    assert got["a", 3] == "C: intersection lane, turn direction RIGHT; left neighbor: none; right neighbor: none"
    assert got["b", 2] == "B: shoulder; left neighbor: a driving lane (dashed line, can be crossed); right neighbor: none; leads into: 2 other lane(s) (intersection lane, turn direction RIGHT, unknown)"
    assert got["b", 4] == "D: intersection lane, turn direction LEFT; left neighbor: none; right neighbor: none"


def test_lane_trace_has_ends_once(spark):
    windows = spark.createDataFrame([(1, -3, 7), (2, 5, 5), (3, 6, 9)], "k int, lo int, hi int")
    got = {}
    for r in describe.lane_trace(windows, "lo", "hi").collect():
        got.setdefault(r["k"], []).append(r["i"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [-3, 0, 5, 7], 2: [5], 3: [6, 9]}


def test_ribbon_is_cut_at_scenes(spark):
    point = "struct<x:double,y:double>"
    sections = spark.createDataFrame([("s", 0, (0.0, 1.0), (0.0, -1.0), False), ("s", 10, (10.0, 1.0), (10.0, -1.0), True), ("s", 20, (20.0, 3.0), (20.0, 1.0), True), ("s", 30, (99.0, 0.0), (99.0, 0.0), False)], f"sid string, time long, left {point}, right {point}, connect boolean")
    scenes = spark.createDataFrame([("s", 4, 10, "turn_left"), ("s", 10, 15, "keep_lane")], "sid string, start long, end long, label string")
    got = sorted((r["start"], r["end"], r["label"], r["from_left"]["x"], r["to_right"]["y"]) for r in view.ribbon(sections, scenes, ["sid"], 7).collect())
    assert got == [(0, 4, None, 0.0, -1.0), (4, 10, "turn_left", 4.0, -1.0), (10, 15, "keep_lane", 10.0, 0.0), (15, 20, None, 15.0, 1.0)]


def test_screen_and_scale(spark):
    row = spark.range(1).select(
        *view.screen_point(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 200.0, 100.0, F.lit(2.0)),
        view.fit_scale(F.array(F.struct(F.lit(44.0).alias("x"), F.lit(0.0).alias("y"))), F.lit(0.0), F.lit(0.0), F.lit(0.0), 200.0, 100.0, 9.0),
        view.positive_or(F.lit(float("nan")), F.lit(2.0)),
    ).collect()[0]
    assert [round(v, 9) for v in row] == [100.0, 45.0, 1.3, 2.0]




def test_camera_path_follows_single_points(spark):
    """Sections against a projection of one point at a time, with distortion, thinning, a gap and a drift that is unknown."""
    rng = np.random.default_rng(3)
    lens = {"translation": [1.6, 0.1, 1.5], "rotation": [0.5, -0.5, 0.5, -0.5], "intrinsic": [[900.0, 0.0, 500.0], [0.0, 900.0, 280.0], [0.0, 0.0, 1.0]], "distortion": [-0.35, 0.1, 0.001, -0.002, -0.02]}
    dt = np.concatenate([np.sort(rng.uniform(0, 7, 160)), np.arange(7.05, 10.4, 0.05)])
    yaw = 0.02 * dt
    poses = np.stack([8 * dt, 0.3 * dt**1.5, 0.02 * dt, np.cos(yaw / 2), 0 * dt, 0 * dt, np.sin(yaw / 2)], 1)
    drift = np.where(rng.random(len(dt)) < 0.1, np.nan, 0.05)
    k1, k2, p1, p2, k3 = lens["distortion"]
    limit = min(r.real for r in np.roots([7 * k3, 5 * k2, 3 * k1, 1]) if abs(r.imag) < 1e-9 and r.real > 0)

    def pixel(point):
        ahead, left, up = point[0] - 1.6, point[1] - 0.1, point[2] - 1.5
        if ahead < 1:
            return None
        x, y = -left / ahead, -up / ahead
        r2 = x * x + y * y
        if r2 >= limit:
            return None
        radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
        return 900 * (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + 500, 900 * (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + 280

    want, world, last, open_ = [], 0, -1.0, False
    for t, p, h, d in zip(dt, poses, yaw, drift, strict=True):
        if t > 10 + 1e-6:
            break
        if t - last < 0.09 and t < 9.99:
            continue
        last, world = t, world + 1
        side = np.array([-math.sin(h), math.cos(h), 0.0])
        ends = [None, None] if math.isnan(d) else [pixel(p[:3] + s * side - (0, 0, 0.3 + d)) for s in (1, -1)]
        if None in ends:
            open_ = False
            continue
        want.append((round(t, 3), *ends[0], *ends[1], open_))
        open_ = True
    got = camera.path(dt, poses, np.zeros(3), np.eye(3), lens, 2.0, 0.5, 0.3, drift)
    assert len(got["world"]) == world and len(got["sections"]) == len(want) > 40
    assert all(np.allclose(g[:5], w[:5], atol=2e-3) and g[5] == w[5] for g, w in zip(got["sections"], want, strict=True))
    assert got["horizon_s"] == 10.0 and [m[0] for m in got["markers"]] == sorted({m[0] for m in got["markers"]})
    cut = camera.path(np.array([0.0, 0.2, 1.5]), poses[:3], np.zeros(3), np.eye(3), lens, 2.0, 0.5, 0.0)
    assert cut["horizon_s"] == 0.2 and len(cut["world"]) == 2
    nothing = camera.path(np.zeros(0), np.zeros((0, 7)), np.zeros(3), np.eye(3), lens, 2.0, 0.5, 0.0)
    assert nothing == {"sections": [], "world": [], "markers": [], "horizon_s": 0.0}


def test_future_poses_end_with_the_session(spark):
    poses = spark.createDataFrame([("s", int(i * S / 2), float(i), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for i in range(60)], "session_id string, t_ns long, x double, y double, z double, qw double, qx double, qy double, qz double")
    images = spark.createDataFrame([("s", S, "a"), ("s", S, "b"), ("s", 24 * S, "c"), ("s", 28 * S, "d")], "session_id string, t_ns long, name string")
    ends = spark.createDataFrame([("s", 27 * S)], "session_id string, end_ns long")
    got = {r["name"]: [p["x"] for p in r["future"]] for r in camera.future_poses(images, poses, ends).collect()}
    assert got["a"] == got["b"] == [float(x) for x in range(2, 23)] and got["c"] == [float(x) for x in range(48, 55)] and got["d"] == []


def test_anchors_of_one_observation(spark):
    rows = spark.createDataFrame([("a", 5.0, 1.0, 0.0), ("b", -1.0, 3.0, 0.0), ("b", 0.1, 2.0, 0.5), ("b", 1.0, 1.0, 0.0), ("b", 2.0, 1.0, 0.0), ("b", 3.0, 4.0, 0.0)], "track string, time_s double, clearance double, share double")
    got = {(r["track"], r["time_s"]): r["reasons"] for r in objects.anchors(rows, ["track"]).collect()}
    assert got == {
        ("a", 5.0): ["first observation", "last observation", "closest body passage", "maximum overlap"], ("b", -1.0): ["first observation", "last clear before overlap"],
        ("b", 0.1): ["NOW", "maximum overlap", "first observed overlap", "last observed overlap"], ("b", 1.0): ["closest body passage", "first observed clear"], ("b", 3.0): ["last observation"],
    }


def test_fixed_text_rounds_binary_values(spark):
    rng = np.random.default_rng(11)
    values = [0.0, 0.005, 0.125, 0.375, 1.005, 2.675, 0.995, 9.995, 99.995, 16416.475, 0.05, 0.25, 0.35, 12345678.905] + [float(v) for v in np.round(rng.uniform(0, 200, 400), 3)] + [float(v) for v in rng.uniform(0, 1e6, 200)] + [k / 8 for k in range(80)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.fixed_text(F.col("v"), 1).alias("a"), scalars.fixed_text(F.col("v"), 2).alias("b"), scalars.fixed_text(F.col("v"), 0).alias("c"), scalars.signed_text(-F.col("v"), 1, " m").alias("d")).collect()
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in rows] == [(f"{r['v']:.1f}", f"{r['v']:.2f}", f"{r['v']:.0f}", scalars.signed(-r["v"], 1, " m")) for r in rows]


def test_reviewed_bodies_keep_no_measured_geometry(spark):
    bodies = spark.createDataFrame([("s", t * S, True, float(t)) for t in range(8)] + [("t", 3 * S, False, 9.0)], "session_id string, t_ns long, ego_data_available boolean, share double")
    reviews = spark.createDataFrame([("s", 3 * S, 4 * S, S, "P1", "camera")], "session_id string, start long, end long, margin long, chain_id string, source string")
    rows = review.reviewed_bodies(bodies, reviews)
    got = {(r["session_id"], r["t_ns"] // S): (r["share"], r["physical_lane_chain"], r["physical_lane_ownership_pct"], r["lane_evidence_source"]) for r in rows.collect()}
    assert got["s", 1] == (1.0, None, None, None) and got["s", 2] == got["s", 5] == (None, None, None, "camera")
    assert got["s", 3] == got["s", 4] == (None, "P1", 100, "camera") and got["t", 3] == (9.0, None, None, None)
    assert rows.filter("ego_data_available is null").count() == 0
    report = review.preparation_report(rows.withColumn("script", F.lit("ab")).withColumn("previous", F.lit("abc"))).orderBy("session_id").collect()
    assert [tuple(r) for r in report] == [("s", 8, 2, 16, 24), ("t", 1, 0, 2, 3)]
