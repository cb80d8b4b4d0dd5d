"""Queries of whole runs: keys by kind of session, answers with failures, totals, ablation and scenes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from . import drive, inference
from .lift import EVENTS, STEP, read
from .registry import query

KINDS = [(side, known, json.dumps({"lateral": [side, str(known)]})) for side in ("left", "right") for known in (True, False)]


class Picky(inference.RuleBackend):
    """Answers no script with an English article."""

    def predict(self, script: str) -> dict:
        if "the " in script.lower():
            raise inference.BackendError(400)
        return super().predict(script)


def _samples(spark, sf):
    """Conversations as sessions, their turns as samples; the third of the sessions keeps left, every second has an indicator."""
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("t_ns"), F.col("text").alias("script"))
    kinds = rows.select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 3 == 0, "left").otherwise("right").alias("side"), (F.col("session_id") % 2 == 0).alias("has_indicator"))
    return rows, kinds


KEY = """'{"model": "default", "questions": {"lateral": ["' || CASE WHEN conv_id % 3 = 0 THEN 'left' ELSE 'right' END || '", "' || CASE WHEN conv_id % 2 = 0 THEN 'True' ELSE 'False' END || '"]}, "state": ' || CAST(to_json(text) AS VARCHAR) || '}'"""


@query("or02_prompts", f"SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS t_ns, CASE WHEN text IS NOT NULL THEN sha256({KEY}) END AS key FROM conversations")
def or02(spark, sf):
    rows, kinds = _samples(spark, sf)
    table = spark.createDataFrame(KINDS, "side string, has_indicator boolean, questions string")
    return drive.prompts(rows, kinds, table).select("session_id", "t_ns", "key")


def _done(spark, sf):
    """Answers where keys are the texts themselves; those of four letters or fewer at the start are cached as keep_lane."""
    rows, _ = _samples(spark, sf)
    asked = rows.withColumn("key", F.col("script"))
    old = F.struct(F.lit("keep_lane").alias("lateral"), F.create_map(F.lit("keep_lane"), F.lit(1.0)).alias("lateral_probs"), F.lit("cruising").alias("longitudinal"), F.create_map(F.lit("cruising"), F.lit(1.0)).alias("longitudinal_probs"), F.lit("old").alias("model"), F.lit(0).cast("long").alias("input_tokens"), F.lit("rules").alias("provider"))
    cache = asked.filter("length(split(script, ' ')[0]) <= 4").select("key", F.lit(1).alias("seq"), old.alias("answer")).dropDuplicates(["key"])
    return drive.answered(asked, cache, Picky)


CACHED = "length(string_split(text, ' ')[1]) <= 4"


@query("or03_answered", f"SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS t_ns, text IS NOT NULL AND NOT {CACHED} AS fresh, CASE WHEN {CACHED} THEN 'keep_lane' WHEN lower(text) LIKE '%the %' THEN NULL WHEN lower(text) LIKE '%left%' THEN 'turn_left' WHEN lower(text) LIKE '%right%' THEN 'turn_right' WHEN text IS NOT NULL THEN 'keep_lane' END AS lateral FROM conversations")
def or03(spark, sf):
    return _done(spark, sf).select("session_id", "t_ns", "fresh", "answer.lateral")


@query(
    "or04_session_report",
    f"WITH c AS (SELECT conv_id AS session_id, text IS NULL OR (NOT {CACHED} AND lower(text) LIKE '%the %') AS bad, text IS NOT NULL AND NOT {CACHED} AND lower(text) LIKE '%the %' AS asked FROM conversations) SELECT session_id, count(*) AS samples, count(*) FILTER (WHERE bad) AS failed, CASE WHEN bool_or(asked) THEN 'the backend answered 400' END AS error FROM c GROUP BY session_id",
)
def or04(spark, sf):
    return drive.session_report(_done(spark, sf))


@query("or03_run_totals", "WITH p AS (SELECT c_custkey AS session_id FROM customer), c AS (SELECT conv_id AS session_id, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY 1), j AS (SELECT p.session_id, n, c FROM p LEFT JOIN c USING (session_id)), t AS (SELECT count(n) AS sessions, count(*) FILTER (WHERE n IS NULL) AS skipped, CAST(coalesce(sum(n), 0) AS BIGINT) AS calls, CAST(coalesce(sum(c), 0) AS BIGINT) AS chars FROM j) SELECT *, chars / 4 + calls * 1400.0::DOUBLE AS tokens, round((chars / 4 + calls * 1400.0::DOUBLE) * 0.042::DOUBLE / 1e6, 9) AS cost_usd FROM t")
def or03_totals(spark, sf):
    """Customers as sessions, of which some have no conversation."""
    rows, _ = _samples(spark, sf)
    return drive.run_totals(rows, read(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"))).withColumn("cost_usd", F.round("cost_usd", 9))


@query("or04_ablated", r"SELECT event_id, E'EVENTS:\n+1.0 s indicator RIGHT on\nOBJECTS:\n' || CASE WHEN event_id % 4 = 0 THEN 'bus 9 m ahead' ELSE event_type || ' 5 m left' END AS script FROM events")
def or04_ablated(spark, sf):
    mapped = F.concat(F.lit("LANES:\nlane A\nEVENTS:\n+1.0 s indicator RIGHT on\n+2.0 s A into right neighbor B\nOBJECTS:\n"), F.col("event_type"), F.lit(" 5 m left in lane A"))
    rows = read(spark, sf, "events").select("event_id", mapped.alias("script"), F.when(F.col("event_id") % 4 == 0, "OBJECTS:\nbus 9 m ahead").alias("plain"))
    return drive.ablated(rows, "plain").select("event_id", "script")


@query("or05_scenes", f"WITH {EVENTS}, s AS (SELECT sid AS session_id, t, CASE WHEN label = 'click' THEN 'turn_left' ELSE 'keep_lane' END AS l FROM (SELECT DISTINCT ON (sid, t) sid, t, label FROM ev ORDER BY sid, t, event_id)), c AS (SELECT *, CASE WHEN lag(l) OVER w IS DISTINCT FROM l OR 2 * (t - lag(t) OVER w) > {3 * STEP} THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY session_id ORDER BY t)), g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t) AS run FROM c), e AS (SELECT session_id, min(t) AS a, max(t) AS b FROM s GROUP BY 1), r AS (SELECT session_id, run, l, min(t) AS a, max(t) AS b FROM g GROUP BY 1, 2, 3) SELECT r.session_id, greatest(r.a - {STEP // 2}, e.a) AS start_us, least(r.b + {STEP // 2}, e.b) AS end_us, l AS lateral FROM r JOIN e USING (session_id) WHERE greatest(r.a - {STEP // 2}, e.a) < least(r.b + {STEP // 2}, e.b)")
def or05(spark, sf):
    """Events asked of the rules, stitched so that a change of label or a gap ends a scene."""
    from .lift import events

    one = events(spark, sf).groupBy("sid", "t").agg(F.min_by("label", "event_id").alias("label"))
    asked = one.select(F.col("sid").alias("session_id"), (F.col("t") * 1000).alias("t_ns"), F.when(F.col("label") == "click", "left").otherwise("on").alias("script")).withColumn("key", F.col("script"))
    none = spark.createDataFrame([], f"key string, seq int, answer struct<{', '.join(f.replace(' ', ':', 1) for f in inference.ANSWER.split(', '))}>")
    ends = one.groupBy(F.col("sid").alias("session_id")).agg((F.min("t") * 1000).alias("session_start"), (F.max("t") * 1000).alias("session_end"))
    found = drive.scenes(drive.answered(asked, none), ends, STEP / 1e6, STEP / 1e6)
    return found.select("session_id", F.expr("start_ns div 1000").alias("start_us"), F.expr("end_ns div 1000").alias("end_us"), "lateral")
