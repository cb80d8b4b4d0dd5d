"""Actors, forks and bodies, by known answers."""

import math

import numpy as np
import pytest

from drivelens import schemas
from drivelens.operators import evidence, geometry, lanes

S = schemas.NS


def test_actor_crossing_a_connector(spark):
    ego = spark.createDataFrame([("s", int(t * S), 0.0, 0.0, 0.0) for t in np.arange(0, 1.01, 0.1)], "session_id string, t_ns long, x double, y double, yaw double")
    rows = [("s", int(t * S), "a", x, y, math.pi / 2, 3.0, 4.0, 2.0) for t, x, y in ((0.0, 8.539, -10.0), (0.5, 8.539, 0.0), (1.0, 8.539, 10.0), (3.0, 0.0, 0.0))]
    actors = spark.createDataFrame(rows, "session_id string, t_ns long, track_id string, x double, y double, yaw double, speed double, length_m double, width_m double")
    road = np.array([(-50.0, -2.0), (50.0, -2.0), (50.0, 2.0), (-50.0, 2.0)])
    got = evidence.actor_observations(actors, ego, road).orderBy("t_ns").collect()
    assert [r["connector_fraction"] for r in got] == [pytest.approx(0), pytest.approx(1), pytest.approx(0)]
    # 8.539 ahead, less half an actor's width and the ego's front at 1.461 + 2.588
    assert got[1]["clearance_m"] == pytest.approx(8.539 - 1 - 4.049) and got[1]["ahead_m"] == pytest.approx(8.539)
    far = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", S, 0.0, 0.0, 0.0)], "session_id string, t_ns long, x double, y double, yaw double")
    assert evidence.actor_observations(actors.filter("t_ns = 500000000"), far).count() == 0


def line(angle, n=25):
    return np.array([(i * math.cos(angle), i * math.sin(angle)) for i in range(n)])


def test_sides_of_branches():
    approach = np.array([(-20.0, 0.0), (0.0, 0.0)])
    sides = evidence.branch_sides(approach, [line(0.3), line(0.0), line(-0.3)])
    assert [s for s, _ in sides] == ["LEFT", "MIDDLE", "RIGHT"] and sides[0][1] == pytest.approx(math.degrees(0.3))
    assert [s for s, _ in evidence.branch_sides(approach, [line(0.3), line(0.28), line(-0.3)])] == ["UNKNOWN", "MIDDLE", "RIGHT"]
    for no_fork in ([line(0.02), line(0.0)], [line(2.0), line(0.0)], [line(0.3, 3), line(0.0)], [line(0.3)]):
        assert evidence.branch_sides(approach, no_fork) is None


def test_forks_need_an_observed_step(spark):
    pts = lambda a: [(float(x), float(y)) for x, y in a]
    table = spark.createDataFrame([(1, "road", None, None, None, [2, 3], [], pts([(-20, 0), (0, 0)])), (2, "road", None, None, None, [], [1], pts(line(0.3))), (3, "road", None, None, None, [], [1], pts(line(-0.3)))], "id long, kind string, turn_direction string, left long, right long, following array<long>, previous array<long>, centerline array<struct<x:double,y:double>>")
    track = spark.createDataFrame([("s", 0, 1, True), ("s", 1, 2, True), ("s", 2, 1, True), ("s", 3, 1, False), ("s", 4, 3, True)], "session_id string, k int, lane_id long, valid boolean")
    got = evidence.forks(track, table, lanes.relations(table)).collect()
    assert [(r["k"], r["source"], r["chosen"], r["side"]) for r in got] == [(1, 1, 2, "LEFT")]


def test_body_evidence(spark):
    box = lambda x0, y0, x1, y1: [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]
    table = spark.createDataFrame([(1, box(0, -1.5, 10, 1.5)), (2, box(0, 1.5, 20, 4.5)), (3, None)], "id long, polygon array<struct<x:double,y:double>>")
    poses = spark.createDataFrame([(1, "s", 5.0, 1.0, 0.0), (2, "t", 5.0, 1.0, 0.0), (3, "s", 500.0, 0.0, 0.0)], "pose_id long, session_id string, x double, y double, yaw double")
    found = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "pose_id long, lane_id long")
    chain = spark.createDataFrame([("s", 1), ("t", 3)], "session_id string, lane_id long")
    got = {r["pose_id"]: r for r in evidence.body_evidence(poses, found, chain, table, 4.0, 2.0, 0.0).collect()}
    assert (got[1]["inside"], got[1]["outside"], got[1]["mapped"]) == (pytest.approx(0.75), pytest.approx(0.25), pytest.approx(1))
    assert got[2]["inside"] is None and got[2]["mapped"] == pytest.approx(0.75) and got[3]["outside"] == 1


def test_batched_geometry_equals_single():
    rng = np.random.default_rng(0)
    n = 200
    x, y, yaw, a, b = rng.uniform(-8, 8, n), rng.uniform(-8, 8, n), rng.uniform(-3, 3, n), rng.uniform(1, 5, n), rng.uniform(1, 3, n)
    bodies, ego = geometry.rectangles(x, y, yaw, a, b), geometry.rectangle(0, 0, 0.4, 4, 2)
    assert np.allclose(bodies[7], geometry.rectangle(x[7], y[7], yaw[7], a[7], b[7]))
    assert np.allclose(geometry.clearances(bodies, ego), [geometry.clearance(p, ego) for p in bodies])
    assert np.allclose(geometry.overlap_areas(ego, bodies), [geometry.overlap_area(ego, p) for p in bodies])
