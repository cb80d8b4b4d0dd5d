import pytest
from pyspark.sql import functions as F

from drivelens.plans import drive, inference

S = 1_000_000_000
ANSWERS = "key string, seq int, answer struct<" + ", ".join(f.replace(" ", ":", 1) for f in inference.ANSWER.split(", ")) + ">"


def _fails():
    # a local class goes to the workers by value: they can't import this module
    class Fails(inference.RuleBackend):
        def predict(self, script):
            if "bad" in script:
                raise inference.BackendError(400)
            return inference.RuleBackend.predict(self, script)

    return Fails


def _asked(spark):
    rows = [("s", 0, "go left"), ("s", S, "bad"), ("t", 0, "go left"), ("t", S, None), ("u", 0, "known")]
    return spark.createDataFrame(rows, "session_id string, t_ns long, script string").withColumn("key", F.col("script"))


def _cache(spark):
    answer = lambda label: (label, {label: 1.0}, "cruising", {"cruising": 1.0}, "m", 3, "rules")
    return spark.createDataFrame([("known", 1, answer("turn_right")), ("known", 2, answer("u_turn"))], ANSWERS)


def test_failures_stay_with_their_session(spark):
    done = drive.answered(_asked(spark), _cache(spark), _fails())
    got = {(r["session_id"], r["t_ns"]): (r["answer"] and r["answer"]["lateral"], r["fresh"]) for r in done.collect()}
    assert got == {("s", 0): ("turn_left", True), ("s", S): (None, True), ("t", 0): ("turn_left", True), ("t", S): (None, False), ("u", 0): ("u_turn", False)}
    report = {r["session_id"]: (r["samples"], r["failed"], r["error"]) for r in drive.session_report(done).collect()}
    assert report == {"s": (2, 1, "the backend answered 400"), "t": (2, 1, None), "u": (1, 0, None)}


def test_strict_run_raises(spark):
    with pytest.raises(Exception, match="answered 400"):
        inference.classify(_asked(spark).filter("key is not null"), _cache(spark).select("key"), _fails()).collect()


def test_prompts_of_unknown_kinds_are_not_asked(spark):
    sessions = spark.createDataFrame([("s", "left", True), ("t", "left", False)], "session_id string, side string, has_indicator boolean")
    questions = spark.createDataFrame([("left", True, '{"q": 1}')], "side string, has_indicator boolean, questions string")
    got = {(r["session_id"], r["t_ns"]): r["key"] for r in drive.prompts(_asked(spark).drop("key"), sessions, questions).collect()}
    assert len(got) == 5 and {k for k, v in got.items() if v} == {("s", 0), ("s", S)} and got["s", 0] != got["s", S]


def test_choice_specs():
    labels = {"version": "1", "lateral": {"keep_lane": "stays"}, "longitudinal": {"stopped": "stands"}, "lateral_instructions": "which"}
    assert drive.choice_specs(labels, True) == {"lateral": {"instructions": "which", "criteria": {"keep_lane": "stays"}}}
    assert list(drive.choice_specs(labels)) == ["lateral", "longitudinal"]


def test_scenes_are_stitched_from_answers(spark):
    rows = [("s", i * S, "go left" if 3 <= i < 6 else "on") for i in range(10)]
    asked = spark.createDataFrame(rows, "session_id string, t_ns long, script string").withColumn("key", F.col("script"))
    done = drive.answered(asked, _cache(spark))
    sessions = spark.createDataFrame([("s", 0, 9 * S)], "session_id string, session_start long, session_end long")
    found = lambda tail: [(r["start_ns"], r["end_ns"], r["lateral"]) for r in drive.scenes(done, sessions, 1.0, 1.0, tail).orderBy("start_ns").collect()]
    assert found(0.0) == [(0, int(2.5 * S), "keep_lane"), (int(2.5 * S), int(5.5 * S), "turn_left"), (int(5.5 * S), 9 * S, "keep_lane")]
    assert found(1.0) == [(0, int(2.5 * S), "keep_lane"), (int(2.5 * S), int(6.5 * S), "turn_left"), (int(6.5 * S), 9 * S, "keep_lane")]


def test_totals_of_no_samples(spark):
    none = _asked(spark).limit(0)
    sessions = spark.createDataFrame([("s",)], "session_id string")
    row = drive.run_totals(none, sessions).collect()[0]
    assert (row["sessions"], row["skipped"], row["calls"], row["chars"], row["cost_usd"]) == (0, 1, 0, 0, 0.0)
