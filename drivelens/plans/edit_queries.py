"""Queries on edits of scenes [ED-01 to ED-08]: each session's scenes, of two phases each, with one edit a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit
from .lift import EVENTS, HOUR, NUMBERED, numbered, spans_sql, truth
from .registry import query

NS = 1000
DAY = 24 * HOUR * NS


def scenes(spark, sf):
    start, end = F.col("start") * NS, F.col("end") * NS
    middle = F.expr("(start + end) div 2") * NS
    phases = F.array(edit.phase(middle, F.lit("first")), edit.phase(end, F.lit("second")))
    return truth(spark, sf).select(F.col("sid").alias("session_id"), start.alias("start_ns"), end.alias("end_ns"), F.col("label").alias("lateral"), phases.alias("phases"))


#: A phase of a scene is a row: session, scene, its label, begin, end and decision.
CELLS = f"""{EVENTS}, {spans_sql('gt', 'ev')}, sc AS (SELECT sid, i, label, a * {NS} AS a, b * {NS} AS b, ((a + b) // 2) * {NS} AS m FROM gt),
ce AS (SELECT sid, CAST(i AS DOUBLE) AS i, label, a, m AS b, 'first' AS d FROM sc UNION ALL SELECT sid, i, label, m, b, 'second' FROM sc),
s0 AS (SELECT * FROM sc WHERE i = 0), s1 AS (SELECT * FROM sc WHERE i = 1), s2 AS (SELECT * FROM sc WHERE i = 2)"""
LISTED = "SELECT sid, min(a) AS start_ns, max(b) AS end_ns, any_value(label) AS label, string_agg(CAST(b AS VARCHAR) || ':' || d, ',' ORDER BY b) AS phases FROM {0} GROUP BY sid, i"


def listed(found):
    text = F.array_join(F.transform("phases", lambda p: F.concat(p["end_ns"].cast("string"), F.lit(":"), p["decision"])), ",")
    return found.select(F.col("session_id").alias("sid"), "start_ns", "end_ns", F.col("lateral").alias("label"), text.alias("phases"))


def one_each(spark, sf, index, **fields):
    """An edit for each session that has a scene of that number, with fields from it (start_ns, end_ns, phases)."""
    from pyspark.sql import Window

    rows = scenes(spark, sf)
    picked = rows.withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy("start_ns")) - 1).filter(F.col("i") == index)
    return rows, picked.select("session_id", F.lit(index).alias("index"), *[(f if not isinstance(f, str) else F.expr(f)).alias(k) for k, f in fields.items()])


@query("ed01_resize", f"WITH {CELLS}, x AS (SELECT ce.sid, ce.i, ce.label, greatest(ce.a, sc.a + {HOUR * NS // 60}) AS a, least(ce.b, sc.b - {HOUR * NS // 60}) AS b, d FROM ce JOIN sc ON sc.sid = ce.sid AND sc.i = ce.i WHERE sc.b - sc.a > {HOUR * NS}) {LISTED.format('x')}")
def ed01(spark, sf):
    minute = HOUR * NS // 60
    return listed(edit.resize(scenes(spark, sf).filter(F.col("end_ns") - F.col("start_ns") > HOUR * NS), F.col("start_ns") + minute, F.col("end_ns") - minute))


@query(
    "ed02_from_documents",
    f"""WITH {EVENTS}, nx AS (SELECT sid, label, t * {NS} AS a, lead(t) OVER w * {NS} AS b, event_id FROM ev WINDOW w AS (PARTITION BY sid ORDER BY t, event_id)), ok AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(b) OVER w = a THEN 0 ELSE 1 END AS c FROM nx WHERE b > a WINDOW w AS (PARTITION BY sid ORDER BY a)),
    x AS (SELECT sid, sum(c) OVER (PARTITION BY sid ORDER BY a) AS i, CASE label WHEN 'view' THEN 'keep_lane' ELSE label END AS label, a, b, 'speed' AS d FROM ok) {LISTED.format('x')}""",
)
def ed02(spark, sf):
    from pyspark.sql import Window

    from .lift import events

    w = Window.partitionBy("sid").orderBy("t", "event_id")
    rows = events(spark, sf).withColumn("b", F.lead("t").over(w)).filter("b > t")
    # documents without phases, and without a label where keep_lane is meant
    label = F.when(F.col("label") != "view", F.col("label"))
    docs = rows.select(F.col("sid").alias("session_id"), (F.col("t") * NS).cast("string").alias("start_ns"), (F.col("b") * NS).cast("string").alias("end_ns"), label.alias("lateral"), F.lit("speed").alias("longitudinal"))
    return listed(edit.from_documents(docs))


@query("ed03_update_phase", f"WITH {CELLS}, x AS (SELECT ce.sid, ce.i, ce.label, CASE WHEN ce.i = 1 AND d = 'second' THEN ce.a - (ce.a - s1.a) // 2 ELSE ce.a END AS a, CASE WHEN ce.i = 1 AND d = 'first' THEN ce.b - (ce.b - ce.a) // 2 ELSE ce.b END AS b, CASE WHEN ce.i = 1 AND d = 'first' THEN 'changed' ELSE d END AS d FROM ce LEFT JOIN s1 USING (sid)) {LISTED.format('x')}")
def ed03_update(spark, sf):
    rows, edits = one_each(spark, sf, 1, phase=F.lit(0), end="phases[0].end_ns - (phases[0].end_ns - start_ns) div 2", decision=F.lit("changed"))
    return listed(edit.update_phase(rows, edits))


@query("ed03_split_phase", f"WITH {CELLS}, x AS (SELECT * FROM ce WHERE NOT (i = 1 AND d = 'first') UNION ALL SELECT sid, i, label, a, a + (b - a) // 2, d FROM ce WHERE i = 1 AND d = 'first' UNION ALL SELECT sid, i, label, a + (b - a) // 2, b, d FROM ce WHERE i = 1 AND d = 'first') {LISTED.format('x')}")
def ed03_split(spark, sf):
    rows, edits = one_each(spark, sf, 1, time="start_ns + (phases[0].end_ns - start_ns) div 2")
    return listed(edit.split_phase(rows, edits))


@query("ed03_remove_phase", f"WITH {CELLS}, x AS (SELECT ce.sid, ce.i, ce.label, CASE WHEN ce.i = 1 THEN s1.a ELSE ce.a END AS a, ce.b, d FROM ce LEFT JOIN s1 USING (sid) WHERE NOT (ce.i = 1 AND d = 'first')) {LISTED.format('x')}")
def ed03_remove(spark, sf):
    rows, edits = one_each(spark, sf, 1, phase=F.lit(0))
    return listed(edit.remove_phase(rows, edits))


@query(
    "ed04_update",
    f"""WITH {CELLS}, n AS (SELECT sid, greatest(b - {3 * HOUR * NS}, a + 100000000) AS e FROM s1),
    x AS (SELECT ce.sid, ce.i, CASE WHEN ce.i = 1 THEN 'edited' ELSE ce.label END AS label, CASE WHEN ce.i = 2 AND d = 'first' THEN least(ce.a, e) ELSE ce.a END AS a, CASE WHEN ce.i = 1 THEN least(ce.b, e) ELSE ce.b END AS b, d
      FROM ce LEFT JOIN n USING (sid) WHERE NOT (ce.i = 1 AND ce.a >= e)) {LISTED.format('x')}""",
)
def ed04(spark, sf):
    none = F.lit(None).cast("long")
    rows, edits = one_each(spark, sf, 1, start=none, end=F.col("end_ns") - 3 * HOUR * NS, lateral=F.lit("edited"), low=F.lit(0).cast("long"), high=F.lit(1 << 62))
    return listed(edit.update(rows, edits))


#: An interval from the middle of a session's first scene to a day later.
PAINTED = f"pt AS (SELECT sid, m AS p, m + {DAY} AS q FROM s0)"
AROUND = "ar AS (SELECT ce.sid, ce.i, label, a, least(b, p) AS b, d FROM ce JOIN pt USING (sid) WHERE a < p UNION ALL SELECT ce.sid, ce.i + 0.5, label, greatest(a, q), b, d FROM ce JOIN pt USING (sid) WHERE b > q)"


def day(spark, sf, **fields):
    return one_each(spark, sf, 0, start="phases[0].end_ns", end=f"phases[0].end_ns + {DAY}", **fields)


@query("ed05_paint", f"WITH {CELLS}, {PAINTED}, {AROUND}, x AS (SELECT * FROM ar UNION ALL SELECT sid, -1, 'painted', p, q, 'stopped' FROM pt) {LISTED.format('x')}")
def ed05(spark, sf):
    rows, edits = day(spark, sf, lateral=F.lit("painted"), longitudinal=F.lit("stopped"))
    return listed(edit.paint(rows, edits.drop("index")))


@query(
    "ed06_paint_lateral",
    f"""WITH {CELLS}, {PAINTED}, {AROUND}, un AS (SELECT ce.sid, -1, 'painted', greatest(a, p) AS a, least(b, q) AS b, d FROM ce JOIN pt USING (sid) WHERE b > p AND a < q), mx AS (SELECT sid, max(b) AS b FROM un GROUP BY sid),
    x AS (SELECT * FROM ar UNION ALL SELECT * FROM un UNION ALL SELECT sid, -1, 'painted', mx.b, q, 'unknown' FROM mx JOIN pt USING (sid) WHERE mx.b < q) {LISTED.format('x')}""",
)
def ed06_lateral(spark, sf):
    rows, edits = day(spark, sf, lateral=F.lit("painted"), low=F.lit(0).cast("long"), high=F.lit(1 << 62))
    return listed(edit.paint_lateral(rows, edits.drop("index")))


@query(
    "ed06_paint_longitudinal",
    f"""WITH {CELLS}, {PAINTED}, x AS (SELECT ce.sid, i, label, a, least(b, p) AS b, d FROM ce JOIN pt USING (sid) WHERE a < p UNION ALL SELECT ce.sid, i, label, greatest(a, p), least(b, q), 'stopped' FROM ce JOIN pt USING (sid) WHERE b > p AND a < q
    UNION ALL SELECT ce.sid, i, label, greatest(a, q), b, d FROM ce JOIN pt USING (sid) WHERE b > q) {LISTED.format('x')}""",
)
def ed06_longitudinal(spark, sf):
    rows, edits = day(spark, sf, decision=F.lit("stopped"), low=F.lit(0).cast("long"), high=F.lit(1 << 62))
    return listed(edit.paint_longitudinal(rows, edits.drop("index")))


@query("ed07_split", f"WITH {CELLS}, x AS (SELECT ce.sid, CASE WHEN i = 2 AND d = 'second' THEN 2.5 ELSE i END AS i, label, a, b, d FROM ce) {LISTED.format('x')}")
def ed07_split(spark, sf):
    rows, edits = one_each(spark, sf, 2, time="phases[0].end_ns")
    return listed(edit.split(rows, edits))


@query("ed07_merge_left", f"WITH {CELLS}, x AS (SELECT ce.sid, CASE WHEN ce.i = 1 THEN 0 ELSE ce.i END AS i, CASE WHEN ce.i = 1 THEN s0.label ELSE ce.label END AS label, ce.a, ce.b, d FROM ce LEFT JOIN s0 USING (sid)) {LISTED.format('x')}")
def ed07_merge(spark, sf):
    rows, edits = one_each(spark, sf, 1)
    return listed(edit.merge_left(rows, edits))


@query("ed07_remove", f"WITH {CELLS}, x AS (SELECT ce.sid, ce.i, ce.label, ce.a, CASE WHEN ce.i = 0 AND d = 'second' THEN coalesce(s1.b, ce.b) ELSE ce.b END AS b, d FROM ce LEFT JOIN s1 USING (sid) WHERE ce.i <> 1) {LISTED.format('x')}")
def ed07_remove(spark, sf):
    rows, edits = one_each(spark, sf, 1)
    return listed(edit.remove(rows, edits))


@query("ed08_at", f"WITH {CELLS}, {NUMBERED[len('ev AS') - 5:].split(', nu AS', 1)[0].replace('ev AS', 'e2 AS', 1)}, q AS (SELECT sid, event_id, t * {NS} + {2 * HOUR * NS} AS t FROM e2) SELECT q.sid, q.event_id, ce.label, ce.d AS decision FROM q LEFT JOIN ce ON ce.sid = q.sid AND ce.a <= q.t AND q.t < ce.b")
def ed08(spark, sf):
    times = numbered(spark, sf).select(F.col("sid").alias("session_id"), "event_id", (F.col("t") * NS + 2 * HOUR * NS).alias("time"))
    return edit.at(scenes(spark, sf), times).select(F.col("session_id").alias("sid"), "event_id", F.col("lateral").alias("label"), "decision")
