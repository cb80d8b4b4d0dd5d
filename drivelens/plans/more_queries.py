"""Further queries of the inventory: smaller joins, windows and array functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, objects, review, scoring, series
from .lift import EVENTS, HOUR, NUMBERED, SESSION, events, numbered, read
from .registry import query


@query("jn03_token_joins", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1, 2")
def jn03(spark, sf):
    """Line items as images, suppliers as their cameras and nations as poses."""
    from ..sources.sqlite import image_poses

    t = lambda n: read(spark, sf, n)
    cameras = t("supplier").select(F.col("s_suppkey").alias("token"), F.col("s_nationkey").alias("nation"))
    nations = t("nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("token"))
    images = t("lineitem").join(cameras.select(F.col("token").alias("l_suppkey"), F.col("nation").alias("pose")), "l_suppkey")
    return image_poses(images, cameras, nations, "l_suppkey", "pose").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    "jn07_landmark",
    f"""WITH {EVENTS}, l AS (SELECT * FROM ev WHERE label = 'view'), r AS (SELECT sid, t, event_id AS rid FROM ev WHERE label = 'click'),
    p AS (SELECT l.sid, l.event_id, r.rid AS pid, l.t - r.t AS pd FROM l ASOF LEFT JOIN r ON l.sid = r.sid AND l.t >= r.t), n AS (SELECT l.event_id, r.rid AS nid, r.t - l.t AS nd FROM l ASOF LEFT JOIN r ON l.sid = r.sid AND l.t <= r.t)
    SELECT p.sid, p.event_id, CASE WHEN pd <= {2 * HOUR} AND (nd IS NULL OR pd <= nd) THEN pid WHEN nd <= {2 * HOUR} AND (pd IS NULL OR nd < pd) THEN nid END AS landmark, CASE WHEN least(pd, nd) <= {2 * HOUR} THEN least(pd, nd) ELSE -1 END AS distance FROM p JOIN n USING (event_id)""",
)
def jn07(spark, sf):
    e = events(spark, sf)
    left, right = e.filter("label = 'view'").select("sid", "event_id", "t"), e.filter("label = 'click'").select("sid", F.col("t").alias("rt"), F.col("event_id").alias("landmark"))
    return asof.nearest(left, right, SESSION, "t", "rt", ["landmark"], 2 * HOUR).select("sid", "event_id", "landmark", F.coalesce("distance", F.lit(-1)).cast("long").alias("distance"))


@query("flt09_landmarks", "SELECT l_shipmode_id, count(*) AS n FROM (SELECT l_linenumber AS l_shipmode_id, * FROM lineitem WHERE l_tax * l_tax <= 0.0016 AND l_quantity > 0 AND l_quantity < 26 AND l_returnflag IN ('A', 'R')) GROUP BY 1")
def flt09(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("still", F.lit(0.0))
    kept = objects.landmarks(rows, "l_tax", "still", "l_quantity", "l_returnflag", ("A", "R"), 0.04, 26.0)
    return kept.groupBy(F.col("l_linenumber").alias("l_shipmode_id")).agg(F.count("*").alias("n"))


@query("flt11_touches", "SELECT event_id, value <= 160 AND value + 20 >= 90 AS touches FROM events")
def flt11(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", review.touches(v, v + 20, F.lit(100.0), F.lit(150.0), F.lit(10.0)).alias("touches"))


@query(
    "flt12_road_shares",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS share, l_returnflag = 'N' AS same, l_linestatus = 'O' AS crossing FROM lineitem), k AS (SELECT l_orderkey, sum(share) FILTER (same AND NOT crossing) AS total, count(*) FILTER (same AND NOT crossing) AS n FROM s GROUP BY 1)
    SELECT l_orderkey, CASE WHEN total > 101 THEN 0 ELSE n END::INTEGER AS lanes FROM k""",
)
def flt12(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("lane"), F.col("l_quantity").alias("share"), F.when(F.col("l_returnflag") == "N", "same").otherwise("crossing").alias("direction"), (F.col("l_linestatus") == "O").alias("intersection"))).alias("o"))
    return rows.select("l_orderkey", F.size(review.road_shares(F.col("o"))).alias("lanes"))


@query("ag01_spans", f"WITH {EVENTS}, x AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t, event_id) - 1 AS i FROM ev), d AS (SELECT sid, i // 3 AS scene, i % 3 AS part, t, label, min(t) OVER (PARTITION BY sid, i // 3) - 1 AS a FROM x) SELECT sid, CAST(scene AS INTEGER) AS scene, CAST(part AS INTEGER) AS part, coalesce(lag(t) OVER (PARTITION BY sid, scene ORDER BY part), a) AS start_us, t AS end_us, label FROM d")
def ag01(spark, sf):
    """Three events each as a scene whose phases end with them."""
    n = numbered(spark, sf).withColumn("scene", F.floor(F.col("i") / 3))
    text = lambda c: c.cast("string")
    phases = F.transform(F.array_sort(F.collect_list(F.struct("t", "label"))), lambda p: F.struct(p["t"].cast("string").alias("end_ns"), p["label"].alias("decision")))
    scenes = n.groupBy("sid", "scene").agg(F.min("t").alias("a"), F.max("t").alias("b"), phases.alias("phases"))
    none = F.lit(None).cast("string")
    scene = F.struct(text(F.col("a") - 1).alias("start_ns"), text(F.col("b")).alias("end_ns"), F.lit("x").alias("driving_decision"), F.col("phases").alias("longitudinal_phases"), none.alias("lateral"), none.alias("longitudinal"))
    docs = scenes.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("scene", scene.alias("s")))), lambda x: x["s"]).alias("scenes")).withColumnRenamed("sid", "session_id")
    return scoring.spans(docs, "longitudinal").select(F.col("session_id").alias("sid"), F.col("at").alias("scene"), "part", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "label")


@query(
    "ag13_window",
    f"""WITH {NUMBERED} SELECT sid, i, round(last_value(v) OVER w - first_value(v) OVER w, 6) AS change, max(v) OVER w AS high, min(v) OVER w AS low, sum(CASE WHEN label = 'error' THEN 1 ELSE 0 END) OVER w::BIGINT AS errors
    FROM nu WINDOW w AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 5 PRECEDING AND 8 FOLLOWING)""".replace("::BIGINT AS errors", " AS errors"),
)
def ag13(spark, sf):
    found = series.window_context(numbered(spark, sf), "v", F.col("label") == "error", SESSION, "i", 5, 8)
    return found.select("sid", "i", F.round("change", 6).alias("change"), "high", "low", F.col("flagged").alias("errors"))


@query("ag21_estimate", "SELECT role, count(*) AS prompts, CAST(floor(sum(length(text)) / 4.0 + count(*) * 1400) AS BIGINT) AS input_tokens FROM conversations GROUP BY role")
def ag21(spark, sf):
    from .inference import CHARS_PER_TOKEN, OVERHEAD_TOKENS

    return read(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("prompts"), F.floor(F.sum(F.length("text")) / CHARS_PER_TOKEN + F.count("*") * OVERHEAD_TOKENS).alias("input_tokens"))


@query("tk06_ranked", "SELECT user_id, string_agg(event_type, '>' ORDER BY n DESC, event_type) AS ranked FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def tk06(spark, sf):
    from .inference import ranked

    counts = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    probs = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("p"))
    return probs.select("user_id", F.array_join(ranked(F.col("p")), ">").alias("ranked"))


@query("tk07_event_order", f"WITH {EVENTS} SELECT sid, string_agg(label, ',' ORDER BY t, event_id) AS labels FROM ev WHERE k < 20 GROUP BY sid")
def tk07(spark, sf):
    listed = series.in_order(events(spark, sf).filter("k < 20"), SESSION, ["t", "event_id"], "label")
    return listed.select("sid", F.array_join("events", ",").alias("labels"))


@query(
    "wn06_resolve_lights",
    f"""WITH {NUMBERED}, m AS (SELECT *, max(i) OVER (PARTITION BY sid) AS last, min(t) OVER (PARTITION BY sid) AS a FROM nu), q AS (SELECT sid, event_id, k, CAST(greatest(0, least(last, round_even((t - a) / {6.0 * HOUR}, 0))) AS INTEGER) AS at FROM m),
    j AS (SELECT q.sid, q.event_id, q.k, n.k AS lane FROM q JOIN nu n ON n.sid = q.sid AND n.i = q.at)
    SELECT sid, event_id, CASE WHEN k % 7 = 0 THEN 'named' WHEN lane % 4 = 0 THEN 'none' WHEN lane % 5 = k % 5 THEN 'red' ELSE 'unknown' END AS light FROM j""",
)
def wn06(spark, sf):
    n = numbered(spark, sf)
    track = n.select("sid", F.col("i").alias("k"), F.when(F.col("k") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("k") % 5).cast("long"))).alias("ahead"))
    start = F.min("t").over(Window.partitionBy("sid"))
    messages = n.select("sid", "event_id", F.col("t").alias("t_ns"), F.create_map((F.col("k") % 5).cast("long"), F.lit("red")).alias("lights"), F.when(F.col("k") % 7 == 0, "named").alias("light_ahead"), start.alias("start"))
    read_ = series.resolve_lights(messages, track, SESSION, "start", 6 * HOUR)
    return read_.join(messages.select("sid", "t_ns", "event_id"), ["sid", "t_ns"]).select("sid", "event_id", "light")


@query("wn11_windows", f"WITH {NUMBERED} SELECT sid, i, greatest(i - 4, 0) AS lo, least(i + 6, max(i) OVER (PARTITION BY sid)) AS hi FROM nu")
def wn11(spark, sf):
    return series.context_window(numbered(spark, sf), SESSION, "i", 4, 6).select("sid", "i", "lo", "hi")
