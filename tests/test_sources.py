"""Readers, documents, benchmarks, edits, inference and the streaming front end."""

import hashlib
import json
import math
import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drivelens import schemas
from drivelens.functions import text
from drivelens.operators import edit, review
from drivelens.plans import inference, rules
from drivelens.sources import documents, maps, sqlite
from drivelens.streaming import segments

S = schemas.NS


def test_session_names():
    assert sqlite.session_name(["/a/log_00600_01084.db", "/a/log_01095_01486.db"]) == "log_00600_01486"
    assert sqlite.session_name(["/a/one.db"]) == "one" and sqlite.session_name(["/a/x.db", "/a/y.db"]) == "x+y"


def log(path, version="town"):
    db = sqlite3.connect(path)
    db.executescript("""create table log(map_version); create table ego_pose(timestamp, x, y, qw, qx, qy, qz, vx, angular_rate_z); create table lidar_pc(token, timestamp);
      create table lidar_box(lidar_pc_token, track_token, x, y, yaw, vx, vy, confidence, length, width); create table track(token, category_token); create table category(token, name);
      create table traffic_light_status(lidar_pc_token, lane_connector_id, status); create table scenario_tag(lidar_pc_token, type); create table image(timestamp, filename_jpg, camera_token); create table camera(token, channel);""")
    db.execute("insert into log values (?)", (version,))
    db.execute("insert into ego_pose values (1000, 1, 2, ?, 0, 0, ?, 4, 0)", (math.cos(0.5), math.sin(0.5)))
    for i, t in enumerate((1000, 201000, 501000)):
        db.execute("insert into lidar_pc values (?, ?)", (bytes([i + 1]), t))
        db.execute("insert into lidar_box values (?, ?, 3, 4, 0, 3, 4, NULL, 4, 2)", (bytes([i + 1]), b"\x01"))
    db.execute("insert into track values (?, ?)", (b"\x01", b"\x09"))
    db.execute("insert into category values (?, 'vehicle')", (b"\x09",))
    db.execute("insert into traffic_light_status values (?, 7, 'red')", (bytes([1]),))
    db.execute("insert into scenario_tag values (?, 'stationary')", (bytes([2]),))
    db.execute("insert into image values (1000, 'a.jpg', ?)", (b"\x05",))
    db.execute("insert into camera values (?, 'CAM_F0')", (b"\x05",))
    db.commit()
    db.close()


def test_read_log(spark, tmp_path):
    log(tmp_path / "a.db")
    got = sqlite.read_log(spark, [str(tmp_path / "a.db")])
    ego = got["ego"].first()
    assert (ego["t_ns"], ego["x"], ego["yaw"]) == (1_000_000, 1.0, pytest.approx(1.0))
    objects = got["objects"].orderBy("t_ns").collect()
    assert [o["t_ns"] for o in objects] == [1_000_000, 501_000_000]  # half a second apart; the one between is dropped
    assert (objects[0]["kind"], objects[0]["speed"], objects[0]["existence"], objects[0]["track_id"]) == ("car", 5.0, 1.0, "01")
    assert got["lights"].first()["lights"] == {7: "red"} and got["tags"].first()["kind"] == "stationary" and got["camera"].first()["file"] == "a.jpg"
    log(tmp_path / "b.db", "village")
    with pytest.raises(ValueError):
        sqlite.read_log(spark, [str(tmp_path / "a.db"), str(tmp_path / "b.db")])


def test_geometry_blobs(tmp_path):
    points = [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    line = struct.pack("<BII", 1, 2, 3) + b"".join(struct.pack("<dd", *p) for p in points)
    ring = struct.pack("<BIII", 1, 3, 1, 3) + b"".join(struct.pack("<dd", *p) for p in points)
    many = struct.pack("<BII", 1, 6, 1) + ring
    for flags, envelope in ((1, 0), (3, 32), (9, 64)):
        for body in (line, ring, many):
            assert maps.geometry_points(b"GP\x00" + bytes([flags]) + bytes(4) + bytes(envelope) + body).tolist() == [list(p) for p in points]
    for version in ("9.12.1817", "9.2.1", "x"):
        (tmp_path / "town" / version).mkdir(parents=True)
    for version in ("9.12.1817", "9.2.1"):
        (tmp_path / "town" / version / "map.gpkg").touch()
    assert maps.find_map(tmp_path, "town").parent.name == "9.12.1817" and maps.find_map(tmp_path, "town", "9.2.1").parent.name == "9.2.1"
    with pytest.raises(FileNotFoundError):
        maps.find_map(tmp_path, "nowhere")


def test_utm():
    # the zone's central meridian, and a known point: 0.5 degrees east at the equator
    assert maps.utm(np.array([9.0]), np.array([0.0]), 32)[0] == pytest.approx([500000, 0])
    east, north = maps.utm(np.array([9.5]), np.array([48.0]), 32)[0]
    assert east == pytest.approx(537_300, abs=30) and north == pytest.approx(5_316_500, abs=300)


OSM = """<?xml version="1.0"?><osm>{nodes}
<way id="101"><nd ref="1"/><nd ref="2"/><tag k="type" v="line_thin"/><tag k="subtype" v="solid"/></way><way id="102"><nd ref="3"/><nd ref="4"/><tag k="type" v="line_thin"/><tag k="subtype" v="dashed"/></way>
<way id="103"><nd ref="5"/><nd ref="6"/><tag k="type" v="line_thin"/><tag k="subtype" v="solid"/></way><way id="104"><nd ref="2"/><nd ref="7"/><tag k="type" v="line_thin"/><tag k="subtype" v="solid"/></way>
<way id="105"><nd ref="4"/><nd ref="8"/><tag k="type" v="line_thin"/><tag k="subtype" v="dashed"/></way>
{lanes}</osm>"""


def test_osm_lanes(spark, tmp_path):
    at = {1: (0, 3.5), 2: (50, 3.5), 3: (0, 0), 4: (50, 0), 5: (0, -3.5), 6: (50, -3.5), 7: (100, 3.5), 8: (100, 0)}
    nodes = "\n".join(f'<node id="{i}"><tag k="local_x" v="{x}"/><tag k="local_y" v="{y}"/></node>' for i, (x, y) in at.items())
    lane = lambda i, a, b: f'<relation id="{i}"><member type="way" role="left" ref="{a}"/><member type="way" role="right" ref="{b}"/><tag k="type" v="lanelet"/><tag k="subtype" v="road"/></relation>'
    path = tmp_path / "map.osm"
    path.write_text(OSM.format(nodes=nodes, lanes="\n".join([lane(10, 101, 102), lane(11, 102, 103), lane(12, 104, 105)])))
    got = {r["id"]: r for r in maps.osm_lanes(spark, str(path)).collect()}
    assert (got[10]["right"], got[10]["right_crossable"], got[10]["left"], got[10]["left_crossable"]) == (11, True, None, False)
    assert got[11]["left"] == 10 and list(got[10]["following"]) == [12] and list(got[12]["previous"]) == [10]
    assert [(p["x"], p["y"]) for p in got[10]["centerline"]] == [(0.0, 1.75), (50.0, 1.75)] and len(got[10]["polygon"]) == 4


def test_strict_json():
    assert documents.strict_json(b'{"a": 1}') == {"a": 1}
    for bad in (b'{"a": 1, "a": 2}', b'{"a": NaN}', b"[]", b'{"a": Infinity}'):
        with pytest.raises(ValueError):
            documents.strict_json(bad)


def document(delay=0):
    edges = [(0, 4 + delay, "keep_lane"), (4 + delay, 8, "lane_change_left"), (8, 12, "keep_lane")]
    t = lambda s: str(1_767_000_000 * S + int(s * S))
    return json.dumps({"scenes": [{"start_ns": t(a), "end_ns": t(b), "driving_decision": x, "longitudinal_phases": [{"end_ns": t(b), "decision": "cruising"}]} for a, b, x in edges]}).encode()


def manifest(folder, runs, **changes):
    digest = lambda n: hashlib.sha256((folder / n).read_bytes()).hexdigest()
    session = {"id": "one", "start_ns": str(1_767_000_000 * S), "end_ns": str(1_767_000_012 * S), "gt": {"path": "gt.json", "sha256": digest("gt.json")}, "runs": {n: {"path": f"{n}.json", "sha256": digest(f"{n}.json")} for n in runs}}
    doc = {"schema_version": documents.BENCHMARK, "name": "n", "kind": "synthetic", "provenance": "p", "run_configuration": {n: {} for n in runs}, "sessions": [session]} | changes
    (folder / "manifest.json").write_text(json.dumps(doc))
    return folder / "manifest.json"


def test_benchmark_of_a_late_run(spark, tmp_path):
    (tmp_path / "gt.json").write_bytes(document())
    (tmp_path / "late.json").write_bytes(document(1))
    report = documents.run_benchmark(spark, manifest(tmp_path, ["late"]), tmp_path / "out")
    run = report["runs"]["late"]
    assert (run["total"]["precision"], run["total"]["recall"], run["timing_s"]["start_abs_median"]) == (1.0, 1.0, 1.0)
    assert run["agreement"] == {"lateral": 0.917, "longitudinal": 1.0}
    assert json.loads((tmp_path / "out/report.json").read_text()) == json.loads(json.dumps(report)) and "| total | 1 | 0 | 0 |" in (tmp_path / "out/report.md").read_text()


@pytest.mark.parametrize("change", [{"schema_version": "other"}, {"kind": "final"}, {"name": ""}, {"sessions": []}, {"run_configuration": {"gt": {}}}, {"run_configuration": {"late": {}, "more": {}}}])
def test_benchmark_refuses(spark, tmp_path, change):
    (tmp_path / "gt.json").write_bytes(document())
    (tmp_path / "late.json").write_bytes(document(1))
    with pytest.raises(ValueError):
        documents.read_benchmark(spark, manifest(tmp_path, ["late"], **change))


def test_frozen_inputs_are_held_to_their_digest_and_cover(spark, tmp_path):
    (tmp_path / "gt.json").write_bytes(document())
    (tmp_path / "late.json").write_bytes(document(1))
    good = json.loads(manifest(tmp_path, ["late"]).read_text())["sessions"][0]
    scenes = documents.read_benchmark(spark, tmp_path / "manifest.json")[1].filter("run = 'late'").first()["scenes"]
    assert [s["start_ns"] for s in scenes] == ["0", str(5 * S), str(8 * S)]
    gt, start, end = good["gt"], int(good["start_ns"]), int(good["end_ns"])
    bad = {
        "digest": {"gt": gt | {"sha256": "0" * 64}}, "cover": {"start_ns": str(start - 1)}, "exactly": {"end_ns": str(end + 1)}, "a path": {"gt": {"path": ""}}, "missing": {"gt": gt | {"path": "none.json"}},
        "order": {"end_ns": good["start_ns"]}, "no id": {"id": " "}, "other runs": {"runs": {}},
    }
    for fault, change in bad.items():
        with pytest.raises(ValueError, match=fault):
            documents.read_benchmark(spark, manifest(tmp_path, ["late"], sessions=[good | change]))
    with pytest.raises(ValueError, match="several sessions"):
        documents.read_benchmark(spark, manifest(tmp_path, ["late"], sessions=[good, good | {"id": "two"}]))
    for broken in (b'{"scenes": 1}', b"{", document().replace(b"cruising", b" Unknown ")):
        (tmp_path / "gt.json").write_bytes(broken)
        with pytest.raises(ValueError, match="form|label"):
            documents.read_benchmark(spark, manifest(tmp_path, ["late"]))
    with pytest.raises(ValueError):
        documents.write_atomically(tmp_path / "gt.json", b"", (tmp_path / "gt.json",))


def test_documents_are_read_with_their_name(spark, tmp_path):
    (tmp_path / "s1.json").write_bytes(document())
    got = documents.read_scenes(spark, str(tmp_path)).collect()
    assert got[0]["session_id"] == "s1" and len(got[0]["scenes"]) == 3


def test_topics(spark):
    have = spark.createDataFrame([("b",), ("i",)], "topic string")
    order = spark.createDataFrame([("ego", 0, "a"), ("ego", 1, "b"), ("indicator", 0, "i")], "role string, rank int, topic string")
    assert {r["role"]: r["topic"] for r in documents.chosen_topics(have, order).collect()} == {"ego": "b", "indicator": "i"}
    with pytest.raises(ValueError):
        documents.chosen_topics(have.filter("topic = 'b'"), order)


def test_templates():
    names = text.sides("left")
    assert text.fill_template("Turn to the {curb} [[with signal||freely]]\n now {FAR}", names, True) == "Turn to the left with signal now RIGHT"
    assert text.fill_template("a[[ b]] c", names, False) == "a c"


def test_without_map():
    script = "LANES:\nlane A\nEVENTS:\n+2.0 s A into right neighbor B\nOBJECTS:\ncar 3 m ahead in lane A"
    assert text.without_map(script) == "EVENTS:\nnone\nOBJECTS:\ncar 3 m ahead"


def row(start, end, lateral, *phases):
    return (start, end, lateral, list(phases) or [(end, "cruising")])


THREE = [row(0, 5, "keep_lane"), row(5, 10, "turn_left", (7, "decelerating"), (10, "accelerating")), row(10, 20, "keep_lane")]
_WHOLE = {"start": "long", "end": "long", "low": "long", "high": "long", "time": "long", "index": "int", "phase": "int", "lateral": "string", "decision": "string"}


def ns(t):
    return None if t is None else round(t * S)


@pytest.fixture
def three(spark):
    rows = [("s", ns(a), ns(b), x, [(ns(e), d) for e, d in p]) for a, b, x, p in THREE]
    return spark.createDataFrame(rows, f"session_id string, start_ns long, end_ns long, lateral string, phases {edit.PHASES}")


def edited(change, scenes, **fields):
    spark = scenes.sparkSession
    value = {k: ns(v) if _WHOLE[k] == "long" else v for k, v in fields.items()}
    asked = spark.createDataFrame([("s", *value.values())], ", ".join(["session_id string", *(f"`{k}` {_WHOLE[k]}" for k in value)]))
    got = change(scenes, asked).orderBy("start_ns").collect()
    return [(r["start_ns"] / S, r["end_ns"] / S, r["lateral"], [(p["end_ns"] / S, p["decision"]) for p in r["phases"]]) for r in got]


def test_bounds_of_scenes(three):
    got = edited(edit.update, three, index=1, start=6, end=12, lateral=None, low=0, high=20)
    assert [(a, b) for a, b, *_ in got] == [(0, 6), (6, 12), (12, 20)] and got[1][3] == [(7, "decelerating"), (12, "accelerating")]
    assert got[0][3] == [(6, "cruising")] and got[2][3] == [(20, "cruising")]
    # neighbours that touch keep a tenth of a second, and the session's bounds hold
    assert [(a, b) for a, b, *_ in edited(edit.update, three, index=1, start=-9, end=None, lateral="u_turn", low=0, high=20)] == [(0, 0.1), (0.1, 10), (10, 20)]
    assert edited(edit.update, three, index=9, start=1, end=2, lateral=None, low=0, high=20) == THREE
    with pytest.raises(Exception, match="tenth of a second"):
        edited(edit.update, three, index=1, start=6, end=6, lateral=None, low=0, high=20)


def test_painting(three):
    got = edited(edit.paint, three, start=3, end=8, lateral="u_turn", low=0, high=20)
    assert [x[:3] for x in got] == [(0, 3, "keep_lane"), (3, 8, "u_turn"), (8, 10, "turn_left"), (10, 20, "keep_lane")]
    assert edited(edit.paint, three, start=25, end=30, lateral="u_turn", low=0, high=20) == THREE
    assert edited(edit.paint_lateral, three, start=4, end=8, lateral="u_turn", low=0, high=20)[1][3] == [(5, "cruising"), (7, "decelerating"), (8, "accelerating")]
    assert edited(edit.paint_longitudinal, three, start=6, end=8, decision="stopped", low=0, high=20)[1][3] == [(6, "decelerating"), (7, "stopped"), (8, "stopped"), (10, "accelerating")]
    apart = three.filter("lateral = 'keep_lane'")
    assert edited(edit.paint_lateral, apart, start=4, end=25, lateral="u_turn", low=0, high=25)[-1] == (4, 25, "u_turn", [(5, "cruising"), (10, "unknown"), (20, "cruising"), (25, "unknown")])


def test_splits_and_merges(three):
    assert [len(edited(edit.split, three, index=1, time=t)) for t in (7, 5.05)] == [4, 3]
    assert edited(edit.split, three, index=1, time=8)[2] == (8, 10, "turn_left", [(10, "accelerating")])
    assert edited(edit.merge_left, three, index=1)[0] == (0, 10, "keep_lane", [(5, "cruising"), (7, "decelerating"), (10, "accelerating")])
    assert edited(edit.merge_left, three, index=0) == THREE
    assert [x[:2] for x in edited(edit.remove, three, index=1)] == [(0, 10), (10, 20)]
    assert edited(edit.remove, three, index=0)[0] == (0, 10, "turn_left", THREE[1][3])
    assert [x[:2] for x in edited(edit.remove, three.filter("start_ns <> 0"), index=0)] == [(5, 20)]


def test_phases(three):
    assert edited(edit.split_phase, three, index=1, time=6)[1][3] == [(6, "decelerating"), (7, "decelerating"), (10, "accelerating")]
    assert edited(edit.remove_phase, three, index=1, phase=1)[1][3] == [(10, "decelerating")]
    assert edited(edit.remove_phase, three, index=1, phase=0)[1][3] == [(10, "accelerating")]
    assert edited(edit.remove_phase, three, index=0, phase=0) == THREE
    assert edited(edit.update_phase, three, index=1, phase=0, end=6, decision="stopped")[1][3] == [(6, "stopped"), (10, "accelerating")]
    assert edited(edit.update_phase, three, index=1, phase=1, end=6, decision="stopped")[1][3] == [(7, "decelerating"), (10, "stopped")]
    with pytest.raises(Exception, match="increase strictly"):
        edited(edit.update_phase, three, index=1, phase=0, end=10, decision=None)


def test_at(spark, three):
    times = spark.createDataFrame([("s", ns(t)) for t in (7, 20, 5)], "session_id string, time long")
    got = {r["time"] // S: (r["lateral"], r["decision"], r["phase_end"]) for r in edit.at(three, times).collect()}
    assert got == {7: ("turn_left", "accelerating", 10 * S), 20: (None, None, None), 5: ("turn_left", "decelerating", 7 * S)}


def test_edits_leave_other_sessions(spark, three):
    other = three.withColumn("session_id", F.lit("t"))
    edits = spark.createDataFrame([("s", 1)], "session_id string, index int")
    for change in (edit.merge_left, edit.remove):
        got = change(three.unionByName(other), edits)
        assert got.filter("session_id = 't'").count() == 3 and got.filter("session_id = 's'").count() == 2
        assert change(three.limit(0), edits).count() == 0


def test_documents_without_phases_join(spark):
    rows = [("s", "0", str(S), "a", "x"), ("s", str(S), str(2 * S), "a", "y"), ("s", str(3 * S), str(4 * S), "a", "y")]
    df = spark.createDataFrame(rows, "session_id string, start_ns string, end_ns string, lateral string, longitudinal string")
    got = sorted((r["start_ns"] // S, r["end_ns"] // S, [(p["end_ns"] // S, p["decision"]) for p in r["phases"]]) for r in edit.from_documents(df).collect())
    assert got == [(0, 2, [(1, "x"), (2, "y")]), (3, 4, [(4, "y")])]


def test_review(spark):
    times = spark.createDataFrame([("s", t, 4, "road") for t in (613, 615, 635)], "session_id string, t_ns long, lane long, road_context string")
    reviews = spark.createDataFrame([("s", 614, 632, 2, 99)], "session_id string, start long, end long, margin long, chain_id long")
    got = {r["t_ns"]: (r["review"], r["lane"]) for r in review.reviewed(times, reviews).collect()}
    assert got == {613: ("margin", None), 615: ("core", 99), 635: ("none", 4)}


def test_classify_asks_once_and_only_what_is_missing(spark):
    prompts = spark.createDataFrame([("a", "turn left"), ("a", "turn left"), ("b", "stop"), ("c", "x")], "key string, script string")
    cache = spark.createDataFrame([("c",)], "key string")
    got = {r["key"]: r["answer"] for r in inference.classify(prompts, cache).collect()}
    assert set(got) == {"a", "b"} and got["a"]["lateral"] == "turn_left" and got["b"]["longitudinal"] == "stopped"


def test_patience():
    waits, calls = [], iter([429, 503, None])

    def ask():
        status = next(calls)
        if status:
            raise inference.BackendError(status)
        return {"ok": 1}

    assert inference.patient(ask, waits.append) == {"ok": 1} and waits == [1.0, 2.0]
    with pytest.raises(inference.BackendError):
        inference.patient(lambda: (_ for _ in ()).throw(inference.BackendError(400)), waits.append)


def test_cache_takes_the_last_row(spark):
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "key string, seq long, answer string")
    assert inference.latest(cache).first()["answer"] == "new"


def test_rules_find_a_turn_and_a_lane_change(spark):
    rows = []
    for k in range(200):
        x, y, yaw = (k * 0.5, 0.0, 0.0) if k < 80 else (40 + 10 * math.sin((k - 80) / 40 * math.pi / 2), 10 - 10 * math.cos((k - 80) / 40 * math.pi / 2), (k - 80) / 40 * math.pi / 2) if k < 120 else (50.0, 10 + (k - 120) * 0.5, math.pi / 2)
        rows.append(("s", k, 1 if k < 80 else 2 if k < 120 else 3 if k < 170 else 4, x, y, yaw))
    track = spark.createDataFrame(rows, "session_id string, k int, lane_id long, x double, y double, yaw double")
    table = spark.createDataFrame([(1, None, None, None, [2], []), (2, "left", None, None, [3], [1]), (3, None, None, 4, [], [2]), (4, None, 3, None, [], [])], "id long, turn_direction string, left long, right long, following array<long>, previous array<long>")
    from drivelens.operators import lanes

    got = {r["label"]: (r["start"], r["end"]) for r in rules.lateral_spans(track, table, lanes.relations(table)).collect()}
    assert set(got) == {"turn_left", "lane_change_right"} and got["lane_change_right"] == (14.5, 19.5) and got["turn_left"][1] == pytest.approx(13.9)


def test_stream_segments(spark, tmp_path):
    source = tmp_path / "in"
    frame = pd.DataFrame({"session_id": ["s"] * 6, "t_ns": [0, S, 2 * S, 10 * S, 11 * S, 500 * S]})
    spark.createDataFrame(frame).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("session_id string, t_ns long").parquet(str(source))
    query = segments.stream_segments(stream, S, "1 second").writeStream.format("memory").queryName("segs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r["seg"], r["start_ns"], r["end_ns"], r["n"]) for r in spark.table("segs").orderBy("seg").collect()]
    assert got[:2] == [(0, 0, 2 * S, 3), (1, 10 * S, 11 * S, 2)]
    assert spark.range(1).select(F.lit(1)).count() == 1
