"""Queries on what the others do not reach: texts, inference, reviews, lanes, benchmarks, readers and writers."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import asof, geometry, lanes, objects, review, series, stitch
from ..sources import documents
from . import inference
from .interval_queries import LEAD, NEEDS, SEG_RUNS, SEGMENTS, SIGNS, segmented
from .lift import BOTH, EVENTS, HALF, HOUR, NUMBERED, SESSION, STEP, candidate, events, numbered, read, truth
from .registry import query


@query("fn15_signed", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE printf('%+.1f', round_even((event_id % 1000) / 8.0::DOUBLE - 60, 1) + 0.0) || ' m' END AS written FROM events")
def fn15(spark, sf):
    value = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 1000) / 8.0 - 60)
    return read(spark, sf, "events").select("event_id", scalars.signed_text(value, 1, " m").alias("written"))


@query("fn16_rotation", "SELECT event_id, round(1 - 2 * sin(value) * sin(value), 6) AS xx, round(-2 * cos(value) * sin(value), 6) AS xy, round(2 * cos(value) * sin(value), 6) AS yx, CAST(1 AS DOUBLE) AS zz FROM events")
def fn16(spark, sf):
    zero = F.lit(0.0)
    m = scalars.rotation_columns(F.cos("value"), zero, zero, F.sin("value"))
    return read(spark, sf, "events").select("event_id", *[F.round(m[i], 6).alias(n) for i, n in ((0, "xx"), (1, "xy"), (3, "yx"), (8, "zz"))])


@query("or09_crossable", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'N' OR l_linestatus = 'O' AS crossable FROM lineitem")
def or09(spark, sf):
    kind, sub = F.when(F.col("l_returnflag") == "N", "virtual").otherwise("line_thin"), F.when(F.col("l_linestatus") == "O", "solid_dashed")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.crossable(kind, sub).alias("crossable"))


@query("or11_emission", "SELECT event_id, round(abs(value - 100) / 1.5 + abs(user_id / 50.0) / radians(30) + 2 * (event_id % 3), 6) AS cost FROM events")
def or11(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(lanes.emission_cost(F.col("value") - 100, F.col("user_id") / 50.0, F.col("event_id") % 3), 6).alias("cost"))


@query("or12_footprint", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE 4 END AS corners, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN round(value + 2.0, 6) END AS front FROM events")
def or12(spark, sf):
    zero, size = F.lit(0.0), F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 7 != 0, 4.0).otherwise(0.0))
    body = geometry.rectangle_column(F.col("value"), zero, zero, size, F.lit(2.0))
    return read(spark, sf, "events").select("event_id", F.coalesce(F.size(body), F.lit(0)).alias("corners"), F.round(F.array_max(F.transform(body, lambda p: p["x"])), 6).alias("front"))


@query("ge06_direction", "SELECT event_id, CASE WHEN abs(value - 100) / 40 > radians(120) THEN 'opposing' WHEN abs(value - 100) / 40 < radians(60) THEN 'same' ELSE 'crossing' END AS direction FROM events")
def ge06(spark, sf):
    return read(spark, sf, "events").select("event_id", geometry.direction((F.col("value") - 100) / 40).alias("direction"))


@query("ge04_reference_frame", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 10.0 AS x, l_discount * 100 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, x AS station, round(y, 6) AS offset_m FROM p WHERE x BETWEEN 0 AND 30")
def ge04(spark, sf):
    line = np.array([(0.0, 0.0), (12.5, 0.0), (30.0, 0.0)])
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - 10.0).alias("x"), (F.col("l_discount") * 100).alias("y"))

    def run(batches):
        for part in batches:
            found = [geometry.line_ends(line, x, y) for x, y in zip(part["x"], part["y"], strict=True)]
            kept = [f is not None for f in found]
            yield part[kept][["l_orderkey", "l_linenumber", "l_partkey"]].assign(station=[f[0] for f in found if f], offset_m=[round(f[1], 6) for f in found if f])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("l_orderkey", "l_linenumber", "l_partkey")) + ", station double, offset_m double")


@query("fn06_path_heading", "WITH p AS (SELECT vec_id, embedding[1] * 40::DOUBLE AS x, embedding[2] * 40::DOUBLE AS y FROM embeddings) SELECT vec_id, round(atan2(y, x), 6) AS heading FROM p WHERE sqrt(x * x + y * y) >= 5")
def fn06(spark, sf):
    from ..operators.evidence import path_heading

    ends = read(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0] * F.lit(40.0)).alias("x"), (F.col("embedding")[1] * F.lit(40.0)).alias("y"))

    def run(batches):
        for part in batches:
            found = [path_heading(np.array([(0.0, 0.0), (x / 3, y / 3), (x, y)]), 20.0) for x, y in zip(part["x"], part["y"], strict=True)]
            yield pd.DataFrame({"vec_id": part["vec_id"], "heading": found}).dropna().round({"heading": 6})

    return ends.mapInPandas(run, "vec_id long, heading double")


LANE_ROWS = 6


@query(
    "jn11_candidates",
    f"""WITH {EVENTS}, p AS (SELECT event_id, v - 50 AS x, k * 0.2 AS y, radians((event_id % 12) * 30.0) AS yaw FROM ev), w AS (SELECT *, yaw + pi() - floor((yaw + pi()) / (2 * pi())) * 2 * pi() - pi() AS h FROM p)
    SELECT event_id, CAST(l AS BIGINT) AS lane_id, round(abs(y - l * 3.5) / 1.5 + abs(h) / radians(30) + 2 * abs(y - l * 3.5), 6) AS cost FROM w CROSS JOIN (SELECT unnest(range({LANE_ROWS})) AS l) WHERE abs(y - l * 3.5) <= 1.0 AND abs(h) < radians(61) AND x BETWEEN -200 AND 400""",
)
def jn11(spark, sf):
    """Events as poses between straight lanes, by their heading."""
    poses = events(spark, sf).select(F.col("event_id").alias("pose_id"), (F.col("v") - 50).alias("x"), (F.col("k") * 0.2).alias("y"), F.radians((F.col("event_id") % 12) * 30.0).alias("yaw")).filter("x between -200 and 400")
    point = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    table = spark.range(LANE_ROWS).select("id", F.array(point(-300.0, F.col("id") * 3.5), point(500.0, F.col("id") * 3.5)).alias("centerline")).withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
    # just above 60 degrees: both sides agree on headings of exactly that
    found = lanes.candidates(poses, table, heading=math.radians(61))
    return found.select(F.col("pose_id").alias("event_id"), "lane_id", F.round("cost", 6).alias("cost"))


@query("flt08_light_changes", f"WITH {EVENTS}, kn AS (SELECT *, lag(label) OVER (PARTITION BY sid ORDER BY t, event_id) AS previous FROM ev WHERE label <> 'error') SELECT sid, event_id, previous, label FROM kn WHERE previous <> label")
def flt08(spark, sf):
    return series.changes(events(spark, sf), "label", SESSION, ["t", "event_id"], "error").select("sid", "event_id", "previous", "label")


@query("or07_grid", f"WITH {EVENTS}, e AS (SELECT sid, min(t) AS a, max(t) AS b FROM ev GROUP BY sid), g AS (SELECT sid, a, unnest(range(CAST((b - a) // {12 * HOUR} + 1 AS BIGINT))) AS i FROM e) SELECT sid, CAST(i AS INTEGER) AS i, a + i * {12 * HOUR} AS t FROM g")
def or07(spark, sf):
    ends = events(spark, sf).groupBy("sid").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return asof.grid(ends, SESSION, 12 * HOUR)


@query(
    "wn16_gate",
    f"""WITH {EVENTS}, {SEGMENTS}, {SEG_RUNS}, {SIGNS}, ru AS (SELECT sid, seg, run, label, min(t) - {HALF} - {LEAD} AS a, max(t) + {HALF} AS b, CASE label WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS need FROM sr GROUP BY sid, seg, run, label),
    kp AS (SELECT sid, seg, run, need IS NULL OR EXISTS (SELECT 1 FROM si WHERE si.sid = ru.sid AND si.code = ru.need AND si.a <= ru.b AND si.b >= ru.a) AS kept FROM ru)
    SELECT sr.sid, event_id, CASE WHEN kept THEN label ELSE 'view' END AS label FROM sr JOIN kp ON kp.sid = sr.sid AND kp.seg = sr.seg AND kp.run = sr.run""",
)
def wn16(spark, sf):
    rows = segmented(spark, sf)
    signs = events(spark, sf).filter("label = 'click'").select("sid", F.col("t").alias("start"), (F.col("t") + 2 * HOUR).alias("end"), F.when(F.col("k") % 2 == 0, 2).otherwise(3).alias("code"))
    # the operator orders runs by time alone, so equal times are told apart
    rows = intervals_by_time(rows)
    return stitch.gate_by_indicator(rows, ["sid", "seg"], SESSION, "at", "label", signs.withColumns({"start": F.col("start") * 1000, "end": F.col("end") * 1000 + 999}), NEEDS, HALF * 1000, LEAD * 1000, "view").select("sid", "event_id", "label")


def intervals_by_time(rows):
    place = F.row_number().over(Window.partitionBy("sid", "t").orderBy("event_id")) - 1
    return rows.withColumn("at", F.col("t") * 1000 + place)


@query(
    "tx04_reviewed",
    f"""WITH {NUMBERED}, rv AS (SELECT sid, min(t) + {24 * HOUR} AS s, min(t) + {96 * HOUR} AS e FROM ev WHERE sid % 3 = 0 GROUP BY sid), x AS (SELECT nu.sid, event_id, k, CASE WHEN s IS NULL THEN 'none' WHEN t BETWEEN s AND e THEN 'core' WHEN t BETWEEN s - {12 * HOUR} AND e + {12 * HOUR} THEN 'margin' ELSE 'none' END AS review FROM nu LEFT JOIN rv ON rv.sid = nu.sid)
    SELECT sid, event_id, review, CASE review WHEN 'core' THEN 7 WHEN 'none' THEN CAST(k AS BIGINT) END AS lane, CASE review WHEN 'core' THEN 'road' WHEN 'none' THEN 'lot' END AS road_context, CASE review WHEN 'core' THEN false WHEN 'none' THEN true END AS intersection, CASE WHEN review = 'none' THEN CAST(1.5 AS DOUBLE) END AS offset_m FROM x""",
)
def tx04(spark, sf):
    rows = numbered(spark, sf).select(F.col("sid").alias("session_id"), "event_id", F.col("t").alias("t_ns"), F.col("k").cast("long").alias("lane"), F.lit("lot").alias("road_context"), F.lit(True).alias("intersection"), F.lit(1.5).alias("offset_m"))
    reviews = events(spark, sf).filter("sid % 3 = 0").groupBy(F.col("sid").alias("session_id")).agg((F.min("t") + 24 * HOUR).alias("start"), (F.min("t") + 96 * HOUR).alias("end")).withColumns({"margin": F.lit(12 * HOUR), "chain_id": F.lit(7)})
    return review.reviewed(rows, reviews).select(F.col("session_id").alias("sid"), "event_id", "review", "lane", "road_context", "intersection", "offset_m")


CACHE = "ca AS (SELECT CAST(k AS VARCHAR) AS key, arg_max(event_type, event_id) AS answer FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k % 4 <> 0 GROUP BY 1)"


def cached(spark, sf):
    e = events(spark, sf)
    prompts = e.select("event_id", F.col("k").cast("string").alias("key"), F.concat(F.lit("script "), F.col("k").cast("string")).alias("script"))
    cache = e.filter("k % 4 <> 0").select(F.col("k").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("label").alias("answer"))
    return prompts, cache


@query("jn20_cache", f"WITH {CACHE}, pr AS (SELECT event_id, json_extract_string(props, '$.k') AS key FROM events) SELECT event_id, key, answer FROM pr LEFT JOIN ca USING (key)")
def jn20(spark, sf):
    prompts, cache = cached(spark, sf)
    return inference.with_cache(prompts, cache).select("event_id", "key", "answer")


@query("jn21_incompatible", f"WITH {CACHE}, pr AS (SELECT event_id, json_extract_string(props, '$.k') AS key FROM events WHERE value > 100) SELECT event_id, key FROM pr WHERE key NOT IN (SELECT key FROM ca)")
def jn21(spark, sf):
    _, cache = cached(spark, sf)
    outside = events(spark, sf).select("event_id", F.col("k").cast("string").alias("key"), F.when(F.col("v") > 100, F.col("label")).alias("answer"))
    return inference.incompatible(outside, cache).select("event_id", "key")


@query("in06_rerun", "SELECT user_id AS sid, event_id, CASE WHEN event_id % 3 = 0 THEN 'fresh' ELSE event_type END AS answer FROM events")
def in06(spark, sf):
    rows = events(spark, sf).select(F.col("sid").alias("session_id"), F.col("event_id").alias("t_ns"), F.col("label").alias("answer"))
    fresh = rows.filter("t_ns % 3 = 0").select("session_id", "t_ns", F.lit("fresh").alias("answer"))
    return inference.rerun(rows, fresh).select(F.col("session_id").alias("sid"), F.col("t_ns").alias("event_id"), "answer")


@query("in03_retry", "SELECT event_id, CASE WHEN f > 0 AND event_id % 5 = 0 THEN false ELSE f < 6 END AS answered, CAST(CASE WHEN f > 0 AND event_id % 5 = 0 THEN 0 ELSE pow(2, least(f, 5)) - 1 END AS DOUBLE) AS waited FROM (SELECT *, event_id % 8 AS f FROM events)")
def in03(spark, sf):
    """A backend that fails as often as the id says, some with a state that is not worth another try."""

    def run(batches):
        for part in batches:
            out = []
            for i in part["event_id"]:
                left, waits = [i % 8], []

                def ask(i=i, left=left):
                    left[0] -= 1
                    if left[0] >= 0:
                        raise inference.BackendError(400 if i % 5 == 0 else 503)
                    return {}

                try:
                    inference.patient(ask, waits.append)
                    out.append((i, True, float(sum(waits))))
                except inference.BackendError:
                    out.append((i, False, float(sum(waits))))
            yield pd.DataFrame(out, columns=["event_id", "answered", "waited"])

    return read(spark, sf, "events").select("event_id").mapInPandas(run, "event_id long, answered boolean, waited double")


@query("in04_parse", "SELECT event_id, CASE WHEN p >= 1 - p THEN event_type ELSE 'other' END AS lateral, round(greatest(p, 1 - p), 6) AS prob FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p FROM events)")
def in04(spark, sf):
    def run(batches):
        for part in batches:
            found = [inference.parse_response({"lateral": {x: p, "other": 1 - p}}, "test") for x, p in zip(part["label"], part["p"], strict=True)]
            yield pd.DataFrame({"event_id": part["event_id"], "lateral": [f["lateral"] for f in found], "prob": [round(f["lateral_probs"][f["lateral"]], 6) for f in found]})

    return events(spark, sf).select("event_id", "label", "p").mapInPandas(run, "event_id long, lateral string, prob double")


@query("in02_backend", "SELECT DISTINCT text AS key, CASE WHEN lower(text) LIKE '%left%' THEN 'turn_left' WHEN lower(text) LIKE '%right%' THEN 'turn_right' ELSE 'keep_lane' END AS lateral, CASE WHEN lower(text) LIKE '%stop%' THEN 'stopped' ELSE 'cruising' END AS longitudinal, CAST(length(text) // 4 AS BIGINT) AS input_tokens FROM conversations WHERE text IS NOT NULL")
def in02(spark, sf):
    prompts = read(spark, sf, "conversations").filter("text is not null").select(F.col("text").alias("key"), F.col("text").alias("script"))
    none = spark.createDataFrame([], "key string")
    return inference.classify(prompts, none).select("key", "answer.lateral", "answer.longitudinal", "answer.input_tokens")


@query("tx03_without_map", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN E'EVENTS:\\nnone\\nOBJECTS:\\ncar 3 m ahead' ELSE E'EVENTS:\\n+1.0 s indicator RIGHT on\\nOBJECTS:\\n' || event_type || ' 5 m left' END AS script FROM events")
def tx03(spark, sf):
    mapped = F.lit("LANES:\nlane A\nEVENTS:\n+2.0 s A into right neighbor B\nOBJECTS:\ncar 3 m ahead in lane A\nBODY:\ninside")
    plain = F.concat(F.lit("FORK:\nnone\nEVENTS:\n+1.0 s indicator RIGHT on\n-1.0 s into successor C\nOBJECTS:\n"), F.col("event_type"), F.lit(" 5 m left in an unmapped area"))
    rows = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, mapped).otherwise(plain).alias("script"))

    def run(batches):
        for part in batches:
            yield part.assign(script=part["script"].map(text.without_map))

    return rows.mapInPandas(run, "event_id long, script string")


@query("fn11_templates", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Turn to the left with signal ' ELSE 'Turn to the left freely ' END || event_type || ' then RIGHT' AS filled FROM events")
def fn11(spark, sf):
    names = text.sides("left")

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"event_id": part["event_id"], "filled": [text.fill_template(f"Turn to the {{curb}} [[with signal||freely]]\n {x}  then {{FAR}}", names, i % 2 == 0) for i, x in zip(part["event_id"], part["event_type"], strict=True)]})

    return read(spark, sf, "events").select("event_id", "event_type").mapInPandas(run, "event_id long, filled string")


@query("or19_relative", f"{BOTH}, o AS (SELECT sid, min(a) AS o FROM gt GROUP BY sid) SELECT gt.sid, CAST(a - o AS VARCHAR) AS start_ns, CAST(b - o AS VARCHAR) AS end_ns, label FROM gt JOIN o USING (sid)")
def or19(spark, sf):
    scene = F.struct(F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), F.col("label").alias("lateral"), F.array(F.struct(F.col("end").alias("end_ns"), F.lit("x").alias("decision"))).alias("phases"))
    docs = truth(spark, sf).groupBy("sid").agg(F.collect_list(scene).alias("scenes"), F.min("start").alias("origin"))
    moved = docs.select("sid", F.explode(documents.relative_scenes(F.col("scenes"), F.col("origin"))).alias("s"))
    return moved.select("sid", "s.start_ns", "s.end_ns", F.col("s.driving_decision").alias("label"))


@query(
    "vd04_input_faults",
    f"""{BOTH}, se AS (SELECT sid, min(a) AS a, max(b) AS b FROM gt GROUP BY sid), r AS (SELECT sid, a, b, unnest(['gt', 'late', 'rules']) AS run FROM se), i AS (SELECT * FROM r WHERE NOT (sid % 7 = 3 AND run = 'rules')),
    x AS (SELECT sid, run, 'the session is repeated or has other runs than the benchmark' AS fault FROM i WHERE sid % 7 = 3 UNION ALL SELECT sid, run, 'an input needs a path and a sha256 of 64 digits' FROM i WHERE sid % 11 = 5 AND run = 'late'
    UNION ALL SELECT sid, run, 'the file is missing or its digest is another' FROM i WHERE (sid % 5 = 1 AND run = 'gt') OR (sid % 11 = 5 AND run = 'late') UNION ALL SELECT sid, run, 'the file belongs to several sessions' FROM i WHERE sid % 10 = 0 AND run = 'rules'
    UNION ALL SELECT sid, run, 'the scenes do not cover the interval exactly' FROM i WHERE sid % 13 = 2 AND run = 'late' UNION ALL SELECT sid, run, 'a scene or phase has no label' FROM i WHERE sid % 17 = 4) SELECT CAST(sid AS VARCHAR) AS session_id, run, fault FROM x""",
)
def vd04(spark, sf):
    """Sessions as a benchmark's inputs, some with faults."""
    spans = truth(spark, sf)
    ends = spans.groupBy("sid").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    all_runs = ends.withColumn("run", F.explode(F.array(*[F.lit(r) for r in ("gt", "late", "rules")]))).filter("not (sid % 7 = 3 and run = 'rules')")
    digest = F.sha2(F.concat_ws("/", "sid", "run"), 256)
    path = F.when((F.col("sid") % 10 == 0) & (F.col("run") == "rules"), F.lit("shared.json")).otherwise(F.concat_ws("/", "sid", "run"))
    inputs = all_runs.select(F.col("sid").cast("string").alias("session_id"), "run", path.alias("file"), path.alias("path"), F.when((F.col("sid") % 11 == 5) & (F.col("run") == "late"), "short").otherwise(digest).alias("sha256"), F.col("a").alias("start_ns"), F.when((F.col("sid") % 13 == 2) & (F.col("run") == "late"), F.col("b") + 1).otherwise(F.col("b")).alias("end_ns"))
    label = F.when(F.col("sid") % 17 == 4, F.lit(" Unknown ")).otherwise(F.col("label"))
    scene = F.struct(F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), label.alias("lateral"), F.array(F.struct(F.col("end").alias("end_ns"), F.lit("cruising").alias("decision"))).alias("phases"))
    scenes = spans.groupBy("sid").agg(F.array_sort(F.collect_list(scene)).alias("scenes"))
    held = all_runs.join(scenes, "sid").select(F.col("sid").cast("string").alias("session_id"), "run", F.when((F.col("sid") % 5 == 1) & (F.col("run") == "gt"), "other").otherwise(digest).alias("digest"), "scenes", F.lit(None).cast("string").alias("fault"))
    return documents.input_faults(inputs, held, ["late", "rules"])


def _folder(spark) -> str:
    from ..streaming.segments import shared_folder

    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query("snk01_tables", f"{BOTH} SELECT CAST(sid AS VARCHAR) AS session_id, a AS start_us, CASE WHEN sid % 2 = 0 THEN 'again' ELSE label END AS label FROM gt")
def snk01(spark, sf):
    """Rows written by session; half of the sessions are written again and replaced, the others stay."""
    rows = truth(spark, sf).select(F.col("sid").cast("string").alias("session_id"), F.col("start").alias("start_us"), "label")
    path = _folder(spark)
    documents.write_table(rows, path)
    documents.write_table(rows.filter("cast(session_id as int) % 2 = 0").withColumn("label", F.lit("again")), path)
    return spark.read.schema("start_us long, label string, session_id string").parquet(path).select("session_id", "start_us", "label")


@query("snk08_answers", "SELECT json_extract_string(props, '$.k') AS key, arg_max(event_type, event_id) AS answer FROM events GROUP BY 1")
def snk08(spark, sf):
    """Answers appended in two runs, read back with the last of each key."""
    rows = events(spark, sf).select(F.col("k").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("label").alias("answer"))
    path = _folder(spark)
    documents.append_answers(rows.filter("seq % 2 = 0"), path)
    documents.append_answers(rows.filter("seq % 2 = 1"), path)
    return inference.latest(spark.read.parquet(path))


@query("src16_scenes", f"{BOTH} SELECT CAST(sid AS VARCHAR) AS session_id, CAST(a * 1000 AS VARCHAR) AS start_ns, CAST(b * 1000 AS VARCHAR) AS end_ns, label AS driving_decision FROM rn")
def src16(spark, sf):
    """Scene documents written by session and read back."""
    rows = candidate(spark, sf).select(F.col("sid").cast("string").alias("session_id"), (F.col("start") * 1000).alias("start_ns"), (F.col("end") * 1000).alias("end_ns"), F.col("label").alias("lateral"))
    scenes = rows.select("*", F.array(F.struct("end_ns", F.lit("cruising").alias("decision"))).alias("phases"), F.lit(1.0).alias("lateral_prob"), F.lit(1.0).alias("longitudinal_prob"))
    ends = rows.groupBy("session_id").agg(F.min("start_ns").alias("session_start"), F.max("end_ns").alias("session_end"))
    path = _folder(spark)
    documents.write_documents(stitch.session_documents(scenes, ends), path)
    found = documents.read_written(spark, path)
    return found.select("session_id", F.explode("scenes").alias("s")).select("session_id", "s.start_ns", "s.end_ns", "s.driving_decision")


@query(
    "or13_object_tracks",
    """WITH o AS (SELECT o_custkey AS now, epoch_us(o_orderdate) AS t, l_orderkey AS frame, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
      l_quantity - 25 AS x, l_extendedprice / 1e4 - 3 AS y, CASE WHEN l_linenumber <> 7 THEN l_partkey % 50 END AS track, 1.0 - l_tax * 8 AS existence, l_returnflag AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    d AS (SELECT *, sqrt(x * x + y * y) AS distance, row_number() OVER (PARTITION BY now, t, track ORDER BY frame, line, pos) AS r FROM o WHERE existence >= 0.5 AND track IS NOT NULL),
    g AS (SELECT now, track, min(distance) AS near, count(*) AS n FROM d WHERE r = 1 GROUP BY now, track HAVING min(distance) <= 30), k AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY near, track) AS rank FROM g)
    SELECT now, track, CAST(rank AS INTEGER) AS rank, n, round(near, 6) AS min_distance FROM k WHERE rank <= 8""",
)
def or13(spark, sf):
    from .lift import objects as lifted

    return objects.object_tracks(lifted(spark, sf), ["now"], "t", "track", "kind", ["frame", "line", "pos"]).select("now", "track", "rank", "n", F.round("min_distance", 6).alias("min_distance"))


@query("src14_spans", f"{BOTH} SELECT CAST(sid AS VARCHAR) AS session, a AS start_ns, b AS end_ns, 'log.db' AS path FROM gt WHERE i = 0")
def src14(spark, sf):
    """Spans written as lists of JSON objects and read back."""
    rows = truth(spark, sf).filter("i = 0").select(F.col("sid").cast("string").alias("session"), F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), F.lit("log.db").alias("path"))
    path = _folder(spark)
    rows.groupBy(F.lit(1)).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).select("value").write.text(path)
    return documents.read_spans(spark, path)
