"""Joins by time, signals, lanes, geometry and scoring, by known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivelens import schemas
from drivelens.operators import asof, geometry, intervals, lanes, objects, scoring, series

S = schemas.NS


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_asof_nearest_interpolate(spark):
    left = table(spark, [("a", t) for t in (0, 5, 10, 15, 30)], "k string, t long")
    right = table(spark, [("a", 5, 1.0), ("a", 15, 2.0)], "k string, rt long, v double")
    back = {r["t"]: r["v"] for r in asof.asof_backward(left, right, ["k"], "t", "rt", ["v"], 10, {"v": -1.0}).collect()}
    assert back == {0: -1.0, 5: 1.0, 10: 1.0, 15: 2.0, 30: -1.0}
    near = {r["t"]: r["v"] for r in asof.nearest(left, right, ["k"], "t", "rt", ["v"], 5).collect()}
    assert near == {0: 1.0, 5: 1.0, 10: 1.0, 15: 2.0, 30: None}  # of equals the earlier
    mid = {r["t"]: r["v"] for r in asof.interpolate(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert mid == {0: 1.0, 5: 1.0, 10: 1.5, 15: 2.0, 30: 2.0}
    kept = {r["t"] for r in asof.supported(asof.interpolate(left, right, ["k"], "t", "rt", ["v"]), 4).collect()}
    assert kept == {5, 15}


def test_clock_of_a_short_session(spark):
    rows = table(spark, [("a", 1, 4), ("b", 3, 11)], "k string, start long, end long")
    assert [(r["k"], r["t"]) for r in asof.clock(rows, ["k"], 5).orderBy("t").collect()] == [("b", 5), ("b", 10)]


@pytest.mark.parametrize("width", [25, 50])
def test_moving_average_repeats_edges(spark, width):
    v = np.random.default_rng(0).normal(size=60)
    rows = table(spark, [("a", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    got = [r["m"] for r in rows.select("i", series.moving_average("v", ["k"], "i", width).alias("m")).orderBy("i").collect()]
    padded = np.pad(v, (width // 2, width - 1 - width // 2), mode="edge")
    assert np.allclose(got, [padded[i : i + width].mean() for i in range(60)])


def test_unwrap_gradient_hysteresis(spark):
    yaw = np.array([3.0, -3.0, 3.1, 0.0, -3.0])
    rows = table(spark, [("a", i, float(x)) for i, x in enumerate(yaw)], "k string, i int, v double")
    assert np.allclose([r["u"] for r in series.unwrap(rows, "v", ["k"], "i", "u").orderBy("i").collect()], np.unwrap(yaw))
    assert np.allclose([r["g"] for r in rows.select("i", series.gradient("v", ["k"], "i", 0.5).alias("g")).orderBy("i").collect()], np.gradient(yaw, 0.5))
    rows = table(spark, [("a", i, x) for i, x in enumerate([0.2, 0.05, 0.2, 0.4, 0.2, 0.0])], "k string, i int, v double")
    assert [r["event"] for r in series.stop_go(rows, "v", ["k"], "i").orderBy("i").collect()] == [None, "stop", None, "start", None, "stop"]


def test_departures_have_three_values(spark):
    outside = [False, True, True, None, True, False, True]
    rows = table(spark, [("a", i, x) for i, x in enumerate(outside)], "k string, i int, o boolean")
    got = [(r["first"], r["last_outside"], r["entry_observed"], r["returned"]) for r in series.departures(rows, ["k"], "i", "o").orderBy("first").collect()]
    assert got == [(1, 2, True, None), (4, 4, False, 5), (6, 6, True, None)]


def test_timeline_of_a_lane_change(spark):
    rows = []
    for i in range(501):
        t = i / 50
        rows.append(("s", int(t * S), 4 * t, 1.75 - 3.5 * min(1, max(0, (t - 3) / 2)), 0.0, 4.0, 0.0))
    ego = table(spark, rows, schemas.EGO)
    got = series.timeline(ego, 20_000_000).orderBy("i").collect()
    assert len(got) == 501 and all(r["valid"] for r in got)
    assert got[200]["y"] == pytest.approx(0.0) and got[200]["v"] == pytest.approx(4.0) and got[250]["jerk"] == pytest.approx(0.0)


def test_upper_median_and_keep_apart(spark):
    rows = table(spark, [("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    assert rows.agg(scoring.upper_median("v").alias("m")).first()["m"] == 3.0
    times = table(spark, [("a", int(x * 100)) for x in (10.0, 10.05, 10.1, 40.0)], "k string, t long")
    assert intervals.keep_apart(times, ["k"], "t", 300).count() == 2


def test_greedy_match_prefers_larger_indexes(spark):
    pairs = table(spark, [("s", "l", 0, 0, 3), ("s", "l", 0, 1, 4), ("s", "l", 1, 1, 4), ("s", "l", 1, 0, 1)], "s string, label string, i int, j int, overlap int")
    got = {(r["i"], r["j"]) for r in intervals.greedy_match(pairs, ["s", "label"]).collect()}
    assert got == {(1, 1), (0, 0)}


@pytest.mark.parametrize(("overlap", "n"), [(500_000_000, 1), (499_999_999, 0)])
def test_overlap_threshold_is_exact(spark, overlap, n):
    g = table(spark, [("s", 0, 10 * S, "a", 0)], "session_id string, start long, end long, label string, i int")
    r = table(spark, [("s", 10 * S - overlap, 20 * S, "a", 0)], "session_id string, start long, end long, label string, i int")
    assert scoring.match_maneuvers(g, r).count() == n


def documents(spark, scenes):
    rows = [("s", [{"start_ns": str(a * S), "end_ns": str(b * S), "driving_decision": x, "longitudinal_phases": [{"end_ns": str(b * S), "decision": "cruising"}], "lateral": None, "longitudinal": None} for a, b, x in scenes])]
    return table(spark, rows, f"session_id string, scenes array<{schemas.SCENE_ROW.simpleString()}>")


def test_score_of_a_late_run(spark):
    truth = documents(spark, [(0, 10, "keep_lane"), (10, 20, "turn_left"), (20, 30, "keep_lane")])
    run = documents(spark, [(0, 11, "keep_lane"), (11, 19, "turn_left"), (19, 25, "keep_lane"), (25, 30, "lane_change_left")])
    got = scoring.score(truth, run)
    total = got["total"].first()
    assert (total["TP"], total["FN"], total["FP"], total["precision"], total["recall"]) == (1, 0, 1, 0.5, 1.0)
    timing = got["timing"].first()
    assert (timing["start_median"], timing["end_median"]) == (1.0, -1.0)
    agreed = {r["key"]: r["agreement"] for r in got["agreement"].collect()}
    assert agreed == {"lateral": 0.767, "longitudinal": 1.0}


def test_spans_of_older_documents(spark):
    rows = [("s", [{"start_ns": "0", "end_ns": "5", "driving_decision": None, "longitudinal_phases": None, "lateral": "turn_left", "longitudinal": ""}])]
    docs = table(spark, rows, f"session_id string, scenes array<{schemas.SCENE_ROW.simpleString()}>")
    assert scoring.spans(docs).first()["label"] == "turn_left"
    assert scoring.spans(docs, "longitudinal").first()["label"] == "unknown"


def test_confusions_are_limited_before_the_diagonal_goes(spark):
    rows = table(spark, [("a", "a", 100), ("a", "b", 5), ("b", "b", 50), ("b", "a", 1)], "gt string, run string, n long")
    assert [(r["gt"], r["run"]) for r in scoring.top_confusions(rows, 3).collect()] == [("a", "b")]


def test_relations_and_decoding(spark):
    rows = [(10, None, 11, [12], []), (11, 10, None, [], []), (12, None, None, [], [10])]
    table_ = table(spark, rows, "id long, left long, right long, following array<long>, previous array<long>")
    edges = {(r["a"], r["b"]): r["relation"] for r in lanes.relations(table_).collect()}
    assert (edges[10, 12], edges[10, 11], edges[11, 10], edges[12, 10]) == ("following", "right", "left", "previous") and (11, 12) not in edges
    layers = [[(10, 0.1), (11, 0.5), (None, 3.0)], [(12, 0.4), (11, 0.3), (None, 3.0)], [(None, 0.0)]]
    assert lanes.decode(layers, lambda a, b: "same" if a == b else edges.get((a, b), "other")) == [10, 12, None]


def test_project_and_shares():
    line = np.array([(0.0, 0.0), (10.0, 0.0)])
    offset, diff, station = lanes.project(line, np.array([5.0]), np.array([1.0]), np.array([math.pi / 2]))
    assert (offset[0], diff[0], station[0]) == (1.0, pytest.approx(math.pi / 2), 5.0)
    body = geometry.rectangle(5, 1, 0, 4, 2)
    one, two = np.array([(0, -1.5), (10, -1.5), (10, 1.5), (0, 1.5)]), np.array([(0, 1.5), (20, 1.5), (20, 4.5), (0, 4.5)])
    got = geometry.occupancy(body, [(1, one), (2, two)], [1])
    assert got["inside"] == pytest.approx(0.75) and got["outside"] == pytest.approx(0.25) and got["mapped"] == pytest.approx(1) and dict(got["lanes"])[2] == pytest.approx(0.25)
    wide = geometry.occupancy(body, [(1, one), (2, np.array([(0, 1.0), (20, 1.0), (20, 4.5), (0, 4.5)]))], [1])
    assert wide["ambiguous"] == pytest.approx(0.25) and wide["mapped"] == pytest.approx(1)
    assert geometry.occupancy(None, [(1, one)], [1])["outside"] is None
    assert geometry.rectangle(0, 0, 0, 4, None) is None and geometry.rectangle(0, 0, 0, -1, 2) is None


def test_clearance_and_corridor():
    a, b = geometry.rectangle(0, 0, 0, 4, 2), geometry.rectangle(10, 0, 0, 4, 2)
    assert geometry.clearance(a, b) == pytest.approx(6) and geometry.clearance(a, geometry.rectangle(3, 1, 0.3, 4, 2)) == 0
    assert geometry.line_clearance(np.array([(-10.0, 3.0), (10.0, 3.0)]), a) == pytest.approx(2)
    assert geometry.line_clearance(np.array([(-10.0, 0.0), (10.0, 0.0)]), a) == 0


def test_lane_candidates_meet_in_cells(spark):
    poses = table(spark, [(1, 25.0, 1.75, 0.0), (2, 25.0, 1.75, math.pi), (3, 49.9, 4.2, 0.0)], "pose_id long, x double, y double, yaw double")
    square = [(0.0, 0.0), (50.0, 0.0), (50.0, 3.5), (0.0, 3.5)]
    table_ = table(spark, [(10, [(0.0, 1.75), (50.0, 1.75)], square)], "id long, centerline array<struct<x:double,y:double>>, polygon array<struct<x:double,y:double>>")
    got = {r["pose_id"]: r for r in lanes.candidates(poses, table_).collect()}
    assert set(got) == {1, 3} and got[1]["cost"] == pytest.approx(0) and got[3]["distance"] == pytest.approx(0.7)


def test_top_tracks_count_what_they_omit(spark):
    rows = table(spark, [("n", i, float(10 - i)) for i in range(10)], "now string, track int, d double")
    got = objects.top_tracks(rows, ["now"], ["d", "track"]).orderBy("rank").collect()
    assert [r["track"] for r in got] == [9, 8, 7, 6, 5, 4, 3, 2] and got[0]["omitted"] == 2


def test_lights_ahead(spark):
    rows = [("s", 0, 0.0, []), ("s", 1, 10.0, []), ("s", 2, 20.0, [7]), ("s", 3, 400.0, [])]
    track = table(spark, rows, "k string, i int, s double, ids array<long>")
    assert [list(r["ahead"]) for r in series.lights_ahead(track, ["k"], "i", "ids", "s").orderBy("i").collect()] == [[7], [7], [7], []]


def test_empty_tables(spark):
    empty = table(spark, [], "k string, start long, end long, label string")
    assert intervals.merge_touching(empty, ["k"]).count() == 0
    assert scoring.confusion(empty, empty, 10, ["k"]).count() == 0
    assert asof.clock(empty, ["k"], 5).count() == 0


def test_scalars(spark):
    from drivelens.functions import scalars

    rows = spark.range(60).select("id", scalars.alias_letters(F.col("id")).alias("a"), scalars.alias_base26(F.col("id")).alias("b")).collect()
    assert (rows[25]["a"], rows[26]["a"], rows[27]["a"], rows[26]["b"], rows[27]["b"], rows[59]["b"]) == ("Z", "AA", "BB", "AA", "AB", "BH")
    assert scalars.signed(-0.04) == "+0.0" and scalars.signed(None) == "unknown" and scalars.shortest(10.0) == "+10"
    assert scalars.cache_key("{}", "x") != scalars.cache_key("{}", "x", provider="p") and len(scalars.cache_key("{}", "x")) == 64


def test_tags_meet_spans_of_any_length(spark):
    # spans of ten years, which no count of buckets of a minute holds
    year = 365 * 86400 * S
    spans = [("a", 0, 10 * year, "turn_left"), ("a", 2 * S, 3 * S, "turn_left"), ("a", 11 * year, 12 * year, "turn_right"), ("b", 100 * S, 200 * S, "turn_left"), ("b", None, 900 * S, "turn_left")]
    lateral = table(spark, spans, "session_id string, start long, end long, label string")
    tags = [("a", t, "starting_left_turn") for t in (5 * year, 10 * year + 5 * S, 10 * year + 20 * S, 11 * year + S)] + [("b", t * S, "starting_left_turn") for t in (94, 98, 205, 210)] + [("b", 150 * S, "stationary"), ("c", 0, "stationary")]
    got = scoring.score_tags(table(spark, tags, "session_id string, t_ns long, kind string"), lateral, lateral.limit(0))
    assert {tuple(r) for r in got.collect()} == {("starting_left_turn", 8, 4, 0.5), ("stationary", 1, 0, 0.0)}
    near = intervals.any_near(table(spark, [("a", 5), ("a", 16), ("z", 5)], "k string, t long"), table(spark, [("a", 0, 9), ("a", 1, 2), ("a", 30, 40)], "k string, start long, end long"), ["k"], "t", 6, "near")
    assert {tuple(r) for r in near.collect()} == {("a", 5, True), ("a", 16, False), ("z", 5, False)}


def test_lights_at_the_reach_do_not_depend_on_rounding(spark):
    # lights 150.00 ahead, which running sums of floats miss by their last bits
    at = np.cumsum([0.07, *[0.1, 74.93, 75.07] * 100])
    assert (at[3::3] - at[1::3] > 150).any()
    rows = [("s", i, float(v), [i] if i % 3 == 0 else []) for i, v in enumerate(at)]
    rows += [("n", i, v, [i] if i == 2 else []) for i, v in enumerate([1.0, float("inf"), float("nan")])] + [("m", 0, 0.0, []), ("m", 1, 150.000001, [1])]
    got = series.lights_ahead(table(spark, rows, "k string, i int, s double, ids array<long>"), ["k"], "i", "ids", "s")
    ahead = {(r["k"], r["i"]): list(r["ahead"]) for r in got.collect()}
    assert all(ahead["s", i] == [-(-i // 3) * 3] for i in range(len(at)))
    assert ahead["n", 0] == ahead["n", 1] == ahead["n", 2] == ahead["m", 0] == []


def test_a_full_cell_meets_in_blocks(spark):
    rng = np.random.default_rng(5)
    poses = [(i, float(x), float(y), float(a), None if i % 3 else f"p{i}") for i, (x, y, a) in enumerate(zip(*rng.uniform(0, 8, (2, 700)), rng.uniform(-1, 1, 700), strict=True))]
    shapes = [[tuple(map(float, p)) for p in np.cumsum(rng.uniform(0, 3, (2 + i % 3, 2)), 0)] for i in range(600)]
    square = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
    lines = [(i, c, square if i % 50 == 0 else None) for i, c in enumerate(shapes)]
    p = table(spark, poses, "pose_id long, x double, y double, yaw double, note string").coalesce(1)
    full = lanes._blocks(p.withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long")), "poses")
    sizes = [r[0] for r in full.select(F.size("poses")).collect()]
    assert sum(sizes) == 700 and max(sizes) == lanes.BLOCK and len(sizes) == 3
    of = table(spark, lines, "id long, centerline array<struct<x:double,y:double>>, polygon array<struct<x:double,y:double>>")
    got = {(r["pose_id"], r["lane_id"]): (r["distance"], r["offset"], r["note"]) for r in lanes.candidates(p, of, 1.0, 2.0, 100.0).collect()}
    x, y, yaw = (np.array([r[k] for r in poses]) for k in (1, 2, 3))
    expected = {}
    for i, c, polygon in lines:
        offset, diff, _ = lanes.project(np.array(c), x, y, yaw)
        distance = np.abs(offset) if polygon is None else geometry.points_to_polygon(np.column_stack([x, y]), np.array(polygon))
        expected |= {(j, i): (float(distance[j]), float(offset[j]), poses[j][4]) for j in np.flatnonzero((distance <= 1) & (np.abs(diff) <= 2))}
    assert len(expected) > 1000 and set(got) == set(expected)
    assert all(got[k][:2] == pytest.approx(v[:2]) and got[k][2] == v[2] for k, v in expected.items())


def test_the_parts_of_a_full_cell_meet_once(spark, monkeypatch):
    monkeypatch.setattr(lanes, "POSES", 100)
    monkeypatch.setattr(lanes, "LANES", 50)
    rng = np.random.default_rng(7)
    poses = [(i, float(x), float(y), float(a)) for i, (x, y, a) in enumerate(zip(*rng.uniform(0, 8, (2, 900)), rng.uniform(-1, 1, 900), strict=True))]
    poses += [(900, 70.0, 70.0, 0.0), (901, None, 0.0, 0.0)]
    shapes = [[tuple(map(float, p)) for p in np.cumsum(rng.uniform(0, 3, (4, 2)), 0)] for _ in range(400)] + [[(69.0, 70.5), (71.0, 70.5)]]
    p = table(spark, poses, "pose_id long, x double, y double, yaw double")
    of = table(spark, [(i, c, None) for i, c in enumerate(shapes)], "id long, centerline array<struct<x:double,y:double>>, polygon array<struct<x:double,y:double>>")
    cells = of.select(F.col("id").alias("lane_id"), "centerline", "polygon", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    met = lanes._meet(p.withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long")), cells, ["pose_id", "x", "y", "yaw"])
    pairs = met.select(F.explode("poses").alias("p"), "lanes").select(F.col("p.pose_id").alias("i"), F.explode("lanes.lane_id").alias("j"))
    assert pairs.count() == pairs.distinct().count() == len(poses) * len(shapes)
    # no block of a pose and a lane is written: the sides are, copied for the parts of the other
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "RoundRobin" not in lanes.candidates(p, of)._jdf.queryExecution().executedPlan().toString()
    got = {(r["pose_id"], r["lane_id"]): (r["distance"], r["offset"], r["heading_diff"]) for r in lanes.candidates(p, of, 1.0, 2.0, 30.0).collect()}
    x, y, yaw = (np.array([r[k] for r in poses], float) for k in (1, 2, 3))
    expected = {}
    for i, c in enumerate(shapes):
        offset, diff, _ = lanes.project(np.array(c), x, y, yaw)
        expected |= {(int(j), i): (abs(float(offset[j])), float(offset[j]), float(diff[j])) for j in np.flatnonzero((np.abs(offset) <= 1) & (np.abs(diff) <= 2))}
    assert len(expected) > 1000 and (900, 400) in expected and got == expected


def test_millionths_are_rounded_as_decimals(spark):
    from drivelens.functions import scalars

    rng = np.random.default_rng(3)
    values = [0.0, -0.0, -1e-9, 0.0000005, 0.1234565, -0.1234565, 2.5e-6, 1e3, 123456.7890125, 1e12 + 0.5, 1e300, float("inf"), float("nan"), None]
    values += [float(v) for v in np.r_[rng.uniform(-2, 2, 5000), np.round(rng.uniform(-2, 2, 5000), 6) + 5e-7, rng.uniform(-1e6, 1e6, 1000)]]
    rows = table(spark, [(v,) for v in values], "v double").select(scalars.millionths(F.col("v")).cast("string").alias("a"), F.round("v", 6).cast("string").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
