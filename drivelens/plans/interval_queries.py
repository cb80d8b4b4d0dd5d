"""Queries on steps, runs, scenes, spans and their scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, scoring, stitch
from .lift import BOTH, EVENTS, HALF, HOUR, SESSION, SHIFT, STEP, candidate, events, runs_sql, spans_sql, truth
from .registry import query

SEGMENTS = f"""sg AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY sid ORDER BY t, event_id) AS BIGINT) AS seg FROM
  (SELECT *, CASE WHEN 2 * (t - lag(t) OVER (PARTITION BY sid ORDER BY t, event_id)) > {3 * STEP} THEN 1 ELSE 0 END AS gap FROM ev))"""
SEG_RUNS = """sr_a AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS c FROM sg WINDOW w AS (PARTITION BY sid, seg ORDER BY t, event_id)),
sr AS (SELECT *, CAST(sum(c) OVER (PARTITION BY sid, seg ORDER BY t, event_id) AS BIGINT) AS run FROM sr_a)"""


def segmented(spark, sf):
    return intervals.number_segments(events(spark, sf), SESSION, "t", STEP, ["event_id"])


@query("wn13_segments", f"WITH {EVENTS}, {SEGMENTS} SELECT sid, seg, count(*) AS n, min(t) AS start_us, max(t) AS end_us FROM sg GROUP BY sid, seg")
def wn13(spark, sf):
    return segmented(spark, sf).groupBy("sid", "seg").agg(F.count("*").alias("n"), F.min("t").alias("start_us"), F.max("t").alias("end_us"))


@query(
    "wn17_scenes_basic",
    f"""WITH {EVENTS}, {SEGMENTS}, {SEG_RUNS}, se AS (SELECT sid, min(t) AS a, max(t) AS b FROM ev GROUP BY sid),
    sc AS (SELECT sid, seg, run, label, greatest(any_value(se.a), min(t) - {HALF}) AS start_us, least(any_value(se.b), max(t) + {HALF}) AS end_us, count(*) AS n, round(avg(p), 6) AS mean_p
      FROM sr JOIN se USING (sid) GROUP BY sid, seg, run, label)
    SELECT * FROM sc WHERE start_us < end_us""",
)
def wn17_basic(spark, sf):
    rows = segmented(spark, sf)
    ends = events(spark, sf).groupBy("sid").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    runs = intervals.as_runs(rows, ["sid", "seg"], "t", "label", ["event_id"], [F.round(F.avg("p"), 6).alias("mean_p")])
    scenes = runs.join(ends, "sid").select("sid", "seg", "run", "label", F.greatest("a", F.col("first") - HALF).alias("start_us"), F.least("b", F.col("last") + HALF).alias("end_us"), "n", "mean_p")
    return scenes.filter("start_us < end_us")


# a merge a round: the first of the shortest runs joins its longer neighbour, and equal neighbours become one
SMOOTHED = f"""WITH RECURSIVE {EVENTS}, {SEGMENTS}, {SEG_RUNS}, ru AS (SELECT sid, seg, run, label, count(*) AS n FROM sr GROUP BY ALL),
ls AS (SELECT sid, seg, list({{'label': label, 'n': n}} ORDER BY run) AS l FROM ru GROUP BY sid, seg),
sm(sid, seg, l, round) AS (SELECT sid, seg, l, 0 FROM ls
  UNION ALL SELECT sid, seg, CASE WHEN i > 1 AND i < len(l) AND l[i - 1].label = l[i + 1].label THEN l[1 : i - 2] || [{{'label': l[i - 1].label, 'n': l[i - 1].n + l[i].n + l[i + 1].n}}] || l[i + 2 :]
    WHEN i = 1 OR (i < len(l) AND l[i + 1].n > l[i - 1].n) THEN l[1 : i - 1] || [{{'label': l[i + 1].label, 'n': l[i].n + l[i + 1].n}}] || l[i + 2 :]
    ELSE l[1 : i - 2] || [{{'label': l[i - 1].label, 'n': l[i - 1].n + l[i].n}}] || l[i + 1 :] END, round + 1
  FROM (SELECT *, list_position([x.n FOR x IN l], list_min([x.n FOR x IN l])) AS i FROM sm) WHERE len(l) > 1 AND l[i].n < 2),
fin AS (SELECT sid, seg, arg_max(l, round) AS l FROM sm GROUP BY sid, seg),
part AS (SELECT sid, seg, unnest(l) AS x, unnest(range(len(l))) AS j FROM fin), cum AS (SELECT sid, seg, x.label AS label, x.n AS n, sum(x.n) OVER (PARTITION BY sid, seg ORDER BY j) AS upto FROM part),
nb AS (SELECT sid, seg, t, event_id, row_number() OVER (PARTITION BY sid, seg ORDER BY t, event_id) AS r FROM sg)
SELECT nb.sid, nb.seg, nb.t AS t_us, nb.event_id, cum.label FROM nb JOIN cum ON cum.sid = nb.sid AND cum.seg = nb.seg AND nb.r <= cum.upto AND nb.r > cum.upto - cum.n"""


@query("wn14_smooth", SMOOTHED)
def wn14(spark, sf):
    return stitch.smooth_column(segmented(spark, sf).select("sid", "seg", F.col("t").alias("t_us"), "event_id", "label"), ["sid", "seg"], ["t_us", "event_id"], "label", 2)


@query(
    "wn15_demote",
    f"""WITH {EVENTS}, {SEGMENTS}, {SEG_RUNS}, m AS (SELECT *, avg(p) OVER (PARTITION BY sid, seg, run) AS mean FROM sr)
    SELECT sid, t AS t_us, label AS label_before, CASE WHEN label <> 'view' AND round(mean, 12) < 0.4 THEN 'view' ELSE label END AS label_after FROM m""",
)
def wn15(spark, sf):
    rows = segmented(spark, sf).withColumn("label_before", F.col("label"))
    return stitch.demote_unsure(rows, ["sid", "seg"], ["t", "event_id"], "label", F.col("p"), 0.4, "view").select("sid", F.col("t").alias("t_us"), "label_before", F.col("label").alias("label_after"))


NEEDS = {"purchase": 2, "signup": 3}
LEAD = 3 * HOUR
SIGNS = "si AS (SELECT sid, t AS a, t + 2 * 3600000000 AS b, CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END AS code FROM ev WHERE label = 'click')"


@query(
    "jn17_gate",
    f"""WITH {EVENTS}, {SEGMENTS}, {SEG_RUNS}, {SIGNS},
    ru AS (SELECT sid, seg, run, label, min(t) - {HALF} - {LEAD} AS a, max(t) + {HALF} AS b, CASE label WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS need FROM sr GROUP BY sid, seg, run, label)
    SELECT sid, seg, run, label, need IS NULL OR EXISTS (SELECT 1 FROM si WHERE si.sid = ru.sid AND si.code = ru.need AND si.a <= ru.b AND si.b >= ru.a) AS kept FROM ru""",
)
def jn17(spark, sf):
    rows = segmented(spark, sf)
    signs = events(spark, sf).filter("label = 'click'").select("sid", F.col("t").alias("start"), (F.col("t") + 2 * HOUR).alias("end"), F.when(F.col("k") % 2 == 0, 2).otherwise(3).alias("code"))
    before = intervals.number_runs(rows, ["sid", "seg"], ["t", "event_id"], "label").withColumn("was", F.col("label"))
    after = stitch.gate_by_indicator(before, ["sid", "seg"], SESSION, "t", "label", signs, NEEDS, HALF, LEAD, "none")
    return after.groupBy("sid", "seg", "run", F.col("was").alias("label")).agg(F.bool_and(F.col("label") == F.col("was")).alias("kept"))


def steps(spark, sf):
    """Events as steps of classified moments: the label is lateral, a band of the value longitudinal. Micros count as nanos."""
    e = events(spark, sf)
    band = F.when(F.col("v") < 20, "stopped").when(F.col("v") < 60, "cruising").when(F.col("v") < 80, "accelerating")
    lateral = F.when(F.col("label") == "view", "keep_lane").otherwise(F.col("label"))
    return e.select(F.col("sid").cast("string").alias("session_id"), (F.col("t") * 1000).alias("t_ns"), lateral.alias("lateral"), F.create_map(lateral, F.col("p")).alias("lateral_probs"), band.alias("longitudinal"), F.when(band.isNotNull(), F.create_map(band, F.col("p"))).alias("longitudinal_probs"))


def sessions(spark, sf):
    return steps(spark, sf).groupBy("session_id").agg(F.min("t_ns").alias("session_start"), F.max("t_ns").alias("session_end"))


def scenes(spark, sf, **more):
    return stitch.stitch(steps(spark, sf), sessions(spark, sf), STEP / 1e6, 2 * STEP / 1e6, min_phase_s=STEP / 1e6, **more)


@query("wn17_stitch")
def wn17(spark, sf):
    return scenes(spark, sf, min_prob=0.4)


@query("wn18_tail_scenes")
def wn18_scenes(spark, sf):
    return stitch.extend_maneuver_ends(scenes(spark, sf), 2 * 3600.0)


@query(
    "wn18_tail",
    f"""WITH {EVENTS}, {spans_sql("gt", "ev")}, nx AS (SELECT *, lead(label) OVER w AS nl, lead(b) OVER w AS nb, lag(label) OVER w AS pl FROM gt WINDOW w AS (PARTITION BY sid ORDER BY i)),
    ex AS (SELECT *, CASE WHEN label NOT IN ('view', 'unknown') AND nl = 'view' THEN least(b + {2 * HOUR}, nb) ELSE b END AS e FROM nx),
    -- a follower that is used up lets its neighbours meet: those of one label become one scene
    st AS (SELECT *, CASE WHEN label = 'view' THEN coalesce(lag(e) OVER (PARTITION BY sid ORDER BY i), a) ELSE a END AS s FROM ex), li AS (SELECT * FROM st WHERE s < e), me AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(e) OVER w = s THEN 0 ELSE 1 END AS new FROM li WINDOW w AS (PARTITION BY sid ORDER BY i)), il AS (SELECT *, sum(new) OVER (PARTITION BY sid ORDER BY i) AS g FROM me)
    SELECT sid, min(s) AS start_us, max(e) AS end_us, label FROM il GROUP BY sid, g, label""",
)
def wn18(spark, sf):
    spans = truth(spark, sf).select(F.col("sid").cast("string").alias("session_id"), F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), F.when(F.col("label") == "view", "keep_lane").otherwise(F.col("label")).alias("lateral"))
    one = spans.withColumn("longitudinal", F.lit("cruising")).withColumn("phases", F.array(F.struct(F.col("end_ns"), F.lit("cruising").alias("decision"))))
    done = stitch.extend_maneuver_ends(one, 2 * HOUR / 1e9)
    return done.select(F.col("session_id").cast("long").alias("sid"), F.col("start_ns").alias("start_us"), F.col("end_ns").alias("end_us"), F.when(F.col("lateral") == "keep_lane", "view").otherwise(F.col("lateral")).alias("label"))


MANEUVERS = """{0}_t AS (SELECT *, CASE WHEN lag(label) OVER w = label AND a - lag(b) OVER w <= 0 THEN 0 ELSE 1 END AS new FROM {0} WINDOW w AS (PARTITION BY sid ORDER BY a, b)),
{0}_g AS (SELECT *, sum(new) OVER (PARTITION BY sid ORDER BY a, b) AS g FROM {0}_t),
{0}_m AS (SELECT sid, label, min(a) AS a, max(b) AS b FROM {0}_g GROUP BY sid, g, label HAVING label <> 'view'),
{0}_n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY a, b) - 1 AS i FROM {0}_m)"""
M = BOTH + ",\n" + MANEUVERS.format("gt") + ",\n" + MANEUVERS.format("rn")


def maneuvers(spans):
    merged = intervals.merge_touching(spans, SESSION, 0, "view")
    return merged.withColumn("i", F.row_number().over(Window.partitionBy("sid").orderBy("start", "end")) - 1)


@query("ag02_maneuvers", f"{M} SELECT sid, CAST(i AS INTEGER) AS i, label, a AS start_us, b AS end_us FROM gt_n")
def ag02(spark, sf):
    return maneuvers(truth(spark, sf)).select("sid", "i", "label", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


LEAST = HOUR
PAIRS = f"""pr AS (SELECT g.sid, g.label, g.i, r.i AS j, least(g.b, r.b) - greatest(g.a, r.a) AS overlap_us, r.a - g.a AS start_error, r.b - g.b AS end_error
  FROM gt_n g JOIN rn_n r ON g.sid = r.sid AND g.label = r.label AND least(g.b, r.b) - greatest(g.a, r.a) >= {LEAST})"""


def pairs(spark, sf):
    found = intervals.overlap_pairs(maneuvers(truth(spark, sf)), maneuvers(candidate(spark, sf)), ["sid", "label"], LEAST, 24 * HOUR)
    return found.withColumnRenamed("r_i", "j")


@query("jn14_overlap_pairs", f"{M}, {PAIRS} SELECT sid, label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, overlap_us FROM pr")
def jn14(spark, sf):
    return pairs(spark, sf).select("sid", "label", "i", "j", F.col("overlap").alias("overlap_us"))


def matched(spark, sf):
    return intervals.greedy_match(pairs(spark, sf), ["sid", "label"])


# a pair that is the largest of all its members' pairs is in every greedy match: what these leave, SQL matches again
ROUND = """{1} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, label, i ORDER BY overlap_us DESC, i DESC, j DESC) AS x, row_number() OVER (PARTITION BY sid, label, j ORDER BY overlap_us DESC, i DESC, j DESC) AS y FROM {0}) WHERE x = 1 AND y = 1),
{2} AS (SELECT p.* FROM {0} p WHERE NOT EXISTS (SELECT 1 FROM {1} m WHERE m.sid = p.sid AND m.label = p.label AND (m.i = p.i OR m.j = p.j)))"""
COLUMNS = "sid, label, i, j, overlap_us, start_error, end_error"
MATCH = ",\n".join([PAIRS] + [ROUND.format("pr" if k == 0 else f"left{k}", f"won{k + 1}", f"left{k + 1}") for k in range(6)]) + ",\nmt AS (" + " UNION ALL ".join(f"SELECT {COLUMNS} FROM won{k + 1}" for k in range(6)) + ")"


@query("tk04_greedy_match", f"{M}, {MATCH} SELECT sid, label, CAST(i AS INTEGER) AS gt_idx, CAST(j AS INTEGER) AS run_idx, overlap_us FROM mt")
def tk04(spark, sf):
    return matched(spark, sf).select("sid", "label", F.col("i").alias("gt_idx"), F.col("j").alias("run_idx"), F.col("overlap").alias("overlap_us"))


@query("or20_match", f"{M}, {MATCH} SELECT sid, label, CAST(i AS INTEGER) AS gt_idx, CAST(j AS INTEGER) AS run_idx, start_error AS start_error_us, end_error AS end_error_us FROM mt")
def or20(spark, sf):
    rows = matched(spark, sf)
    return rows.select("sid", "label", F.col("i").alias("gt_idx"), F.col("j").alias("run_idx"), (F.col("r_start") - F.col("start")).alias("start_error_us"), (F.col("r_end") - F.col("end")).alias("end_error_us"))


@query(
    "ag03_precision_recall",
    f"""{M}, {MATCH}, c AS (SELECT label, sum(g) AS n_gt, sum(r) AS n_run, sum(m) AS tp FROM
      (SELECT label, 1 AS g, 0 AS r, 0 AS m FROM gt_n UNION ALL SELECT label, 0, 1, 0 FROM rn_n UNION ALL SELECT label, 0, 0, 1 FROM mt) GROUP BY label)
    SELECT label, CAST(tp AS BIGINT) AS "TP", CAST(n_gt - tp AS BIGINT) AS "FN", CAST(n_run - tp AS BIGINT) AS "FP",
      round_even(CAST(tp AS DOUBLE) / nullif(n_run, 0), 3) AS precision, round_even(CAST(tp AS DOUBLE) / nullif(n_gt, 0), 3) AS recall FROM c""",
)
def ag03(spark, sf):
    return scoring.precision_recall(maneuvers(truth(spark, sf)), maneuvers(candidate(spark, sf)), matched(spark, sf))


@query("ag04_upper_median", f"WITH {EVENTS} SELECT label, list_sort(list(v))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM ev GROUP BY label")
def ag04(spark, sf):
    return events(spark, sf).groupBy("label").agg(scoring.upper_median("v", None).alias("upper_median"))


GRID = HOUR // 4
CONFUSED = f"""pt AS (SELECT sid, label AS gt, a + k * {GRID} + {GRID // 2} AS t FROM (SELECT *, unnest(range(CAST(round_even((b - a) / {GRID}.0, 0) AS BIGINT))) AS k FROM gt) WHERE a + k * {GRID} + {GRID // 2} < b),
cf AS (SELECT pt.gt, coalesce(r.label, '(none)') AS run, count(*) AS n FROM pt LEFT JOIN rn r ON r.sid = pt.sid AND r.a <= pt.t AND pt.t < r.b GROUP BY 1, 2)"""


def confused(spark, sf):
    return scoring.confusion(truth(spark, sf), candidate(spark, sf), GRID, SESSION).groupBy("gt", "run").agg(F.sum("n").alias("n"))


@query("ag05_confusion", f"{BOTH}, {CONFUSED} SELECT gt, run, CAST(n AS BIGINT) AS n FROM cf")
def ag05(spark, sf):
    return confused(spark, sf)


@query("ag06_agreement", f"{BOTH}, {CONFUSED} SELECT round_even(CAST(sum(n) FILTER (gt = run) AS DOUBLE) / sum(n), 3) AS agreement FROM cf")
def ag06(spark, sf):
    return scoring.agreement(confused(spark, sf))


@query("ag07_top12", f"{BOTH}, {CONFUSED} SELECT gt, run, CAST(n AS BIGINT) AS n FROM (SELECT * FROM cf ORDER BY n DESC, gt, run LIMIT 12) WHERE gt <> run")
def ag07(spark, sf):
    return scoring.top_confusions(confused(spark, sf))


@query(
    "ag08_calibration",
    f"""{BOTH}, st AS (SELECT ev.sid, ev.label, ev.p, r.label AS truth FROM ev LEFT JOIN rn r ON r.sid = ev.sid AND r.a <= ev.t AND ev.t < r.b)
    SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS steps, round_even(CAST(sum(CASE WHEN label = truth THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS correct FROM st WHERE truth IS NOT NULL GROUP BY 1""",
)
def ag08(spark, sf):
    placed = intervals.label_at(events(spark, sf).select("sid", "t", "label", "p"), candidate(spark, sf).drop("i"), SESSION, "t", "truth")
    return scoring.calibration(placed)


@query("jn15_label_at", f"{BOTH} SELECT ev.sid, ev.event_id, r.label AS run_label FROM ev LEFT JOIN rn r ON r.sid = ev.sid AND r.a <= ev.t AND ev.t < r.b")
def jn15(spark, sf):
    return intervals.label_at(events(spark, sf).select("sid", "event_id", "t"), candidate(spark, sf).drop("i"), SESSION, "t", "run_label").select("sid", "event_id", "run_label")


REACH = 5 * HOUR


@query("jn16_tag_window", f"{BOTH} SELECT ev.sid, ev.event_id, count(*) AS n, sum(CASE WHEN r.label = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS n_purchase FROM ev JOIN rn r ON r.sid = ev.sid AND r.a <= ev.t + {REACH} AND r.b >= ev.t - {REACH} WHERE ev.label = 'error' GROUP BY 1, 2")
def jn16(spark, sf):
    tags = events(spark, sf).filter("label = 'error'").select("sid", "event_id", "t")
    near = intervals.near_points(tags, candidate(spark, sf).drop("i"), SESSION, "t", REACH, 24 * HOUR)
    return near.groupBy("sid", "event_id").agg(F.count("*").alias("n"), F.sum((F.col("label") == "purchase").cast("long")).alias("n_purchase"))


def kept_sql(source: str, gap: int, op: str) -> str:
    return f"""WITH RECURSIVE {EVENTS}, s AS (SELECT sid, t, row_number() OVER (PARTITION BY sid ORDER BY t) AS r FROM ev WHERE {source}),
    k(sid, r, t, kept, last) AS (SELECT sid, r, t, true, t FROM s WHERE r = 1
      UNION ALL SELECT s.sid, s.r, s.t, s.t - k.last {op} {gap}, CASE WHEN s.t - k.last {op} {gap} THEN s.t ELSE k.last END FROM k JOIN s ON s.sid = k.sid AND s.r = k.r + 1)
    SELECT sid, t AS t_us FROM k WHERE kept"""


@query("ag10_tag_events", kept_sql("label = 'error'", 48 * HOUR, ">"))
def ag10(spark, sf):
    return intervals.keep_apart(events(spark, sf).filter("label = 'error'"), SESSION, "t", 48 * HOUR).withColumnRenamed("t", "t_us")


@query("wn20_throttle", kept_sql("true", 12 * HOUR, ">="))
def wn20(spark, sf):
    return intervals.keep_apart(events(spark, sf), SESSION, "t", 12 * HOUR, strict=False).withColumnRenamed("t", "t_us")


@query(
    "ag09_tag_score",
    f"""WITH RECURSIVE {EVENTS}, {spans_sql("rn", "ev", SHIFT, "k >= 40")}, s AS (SELECT sid, label AS kind, t, row_number() OVER (PARTITION BY sid, label ORDER BY t) AS r FROM ev WHERE label IN ('error', 'signup')),
    k(sid, kind, r, t, kept, last) AS (SELECT sid, kind, r, t, true, t FROM s WHERE r = 1
      UNION ALL SELECT s.sid, s.kind, s.r, s.t, s.t - k.last > 3000000, CASE WHEN s.t - k.last > 3000000 THEN s.t ELSE k.last END FROM k JOIN s ON s.sid = k.sid AND s.kind = k.kind AND s.r = k.r + 1),
    h AS (SELECT k.*, CASE WHEN kind = 'error' THEN EXISTS (SELECT 1 FROM rn WHERE rn.sid = k.sid AND rn.a <= k.t + 5000000 AND rn.b >= k.t - 5000000 AND rn.label = 'purchase')
      ELSE EXISTS (SELECT 1 FROM rn WHERE rn.sid = k.sid AND rn.a <= k.t AND k.t < rn.b AND rn.label IN ('signup', 'click')) END AS hit FROM k WHERE kept AND sid IN (SELECT sid FROM rn))
    SELECT kind, count(*) AS events, sum(hit::INT)::BIGINT AS found, round_even(sum(hit::INT)::DOUBLE / count(*), 3) AS share FROM h GROUP BY kind""",
)
def ag09(spark, sf):
    tags = events(spark, sf).select(F.col("sid").alias("session_id"), (F.col("t") * 1000).alias("t_ns"), F.col("label").alias("kind"))
    runs = candidate(spark, sf).select(F.col("sid").alias("session_id"), (F.col("start") * 1000).alias("start"), (F.col("end") * 1000).alias("end"), "label")
    return scoring.score_tags(tags, runs, runs, {"error": ("lateral", ("purchase",)), "signup": ("longitudinal", ("signup", "click"))})


@query("ag24_indicator_segments", f"WITH {EVENTS}, {runs_sql('x', 'ev')}, e AS (SELECT *, coalesce(lead(first) OVER (PARTITION BY sid ORDER BY run), max(last) OVER (PARTITION BY sid)) AS fin FROM x_r) SELECT sid, first AS start_us, fin AS end_us, label AS code FROM e WHERE label IN ('click', 'error')")
def ag24(spark, sf):
    found = intervals.change_segments(events(spark, sf), SESSION, "t", "label", ["click", "error"], ["event_id"])
    return found.select("sid", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "code")


@query("ag11_mean_probability", f"WITH {EVENTS}, {SEGMENTS}, {SEG_RUNS} SELECT sid, seg, run, round(avg(CASE WHEN k % 3 = 0 THEN 0 ELSE p END), 6) AS mean_p FROM sr GROUP BY sid, seg, run")
def ag11(spark, sf):
    rows = intervals.number_runs(segmented(spark, sf), ["sid", "seg"], ["t", "event_id"], "label").withColumn("probs", F.create_map(F.when(F.col("k") % 3 == 0, "other").otherwise(F.col("label")), F.col("p")))
    return rows.groupBy("sid", "seg", "run").agg(F.round(F.avg(F.coalesce(F.try_element_at("probs", F.col("label")), F.lit(0.0))), 6).alias("mean_p"))


@query("ag22_support_mean", f"{BOTH} SELECT r.sid, r.i, round(avg(ev.p), 6) AS support FROM rn r LEFT JOIN ev ON ev.sid = r.sid AND r.a <= ev.t AND ev.t < r.b GROUP BY r.sid, r.i")
def ag22(spark, sf):
    runs = candidate(spark, sf)
    spans = runs.select("sid", "start", "end", F.col("i").cast("string").alias("label"))
    inside = intervals.label_at(events(spark, sf).select("sid", "t", "p"), spans, SESSION, "t", "i").filter("i is not null").groupBy("sid", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("p"), 6).alias("support"))
    return runs.select("sid", "i").join(inside, ["sid", "i"], "left")


@query("jn18_protected", f"{M} SELECT g.sid, CAST(g.i AS INTEGER) AS i, coalesce(min(CASE WHEN r.a <= g.b AND g.b < r.b THEN g.b WHEN g.b < r.a AND r.a < g.b + {2 * HOUR} THEN r.a END), g.b + {2 * HOUR}) AS limit_us FROM gt_n g LEFT JOIN rn_n r ON r.sid = g.sid GROUP BY g.sid, g.i, g.b")
def jn18(spark, sf):
    own = maneuvers(truth(spark, sf)).select("sid", "i", F.col("end").alias("own"))
    held = maneuvers(candidate(spark, sf)).select("sid", "start", "end", "label")
    reach = own.withColumn("t", F.col("own") + HOUR)
    near = intervals.near_points(reach, held, SESSION, "t", HOUR, 24 * HOUR)
    cut = F.when((F.col("start") <= F.col("own")) & (F.col("own") < F.col("end")), F.col("own")).when((F.col("own") < F.col("start")) & (F.col("start") < F.col("own") + 2 * HOUR), F.col("start"))
    first = near.groupBy("sid", "i").agg(F.min(cut).alias("cut"))
    return own.join(first, ["sid", "i"], "left").select("sid", "i", F.coalesce("cut", F.col("own") + 2 * HOUR).alias("limit_us"))


@query("vd03_coverage", f"{BOTH}, c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY sid ORDER BY a, b) = a, true) AND a < b AS j FROM rn), e AS (SELECT sid, min(t) AS a, max(t) + {STEP} AS b FROM ev GROUP BY sid), w AS (SELECT sid, min(a) AS a, max(b) AS b, bool_and(j) AS j FROM c GROUP BY sid) SELECT e.sid, coalesce(w.a = e.a + {SHIFT} AND w.b = e.b + {SHIFT} AND w.j, false) AS ok FROM e LEFT JOIN w USING (sid)")
def vd03(spark, sf):
    ends = events(spark, sf).groupBy("sid").agg((F.min("t") + SHIFT).alias("session_start"), (F.max("t") + STEP + SHIFT).alias("session_end"))
    return intervals.covered(candidate(spark, sf), SESSION, ends)


@query(
    "vd01_scene_violations",
    f"""{BOTH}, d AS (SELECT sid, a, CASE WHEN i % 7 = 3 THEN a ELSE b END AS b, CASE WHEN i % 5 = 2 THEN '' ELSE label END AS label, CASE WHEN i % 11 = 4 THEN b + 1 ELSE CASE WHEN i % 7 = 3 THEN a ELSE b END END AS e FROM gt)
    SELECT sid, a AS start_us, unnest(['empty_interval', 'phase_order']) AS rule FROM d WHERE a >= b AND e <= a
    UNION ALL SELECT sid, a, 'empty_interval' FROM d WHERE a >= b AND e > a UNION ALL SELECT sid, a, 'no_label' FROM d WHERE label = '' UNION ALL SELECT sid, a, 'phase_end' FROM d WHERE e <> b""",
)
def vd01(spark, sf):
    b = F.when(F.col("i") % 7 == 3, F.col("start")).otherwise(F.col("end"))
    e = F.when(F.col("i") % 11 == 4, F.col("end") + 1).otherwise(b)
    rows = truth(spark, sf).select(F.col("sid").alias("session_id"), F.col("start").alias("start_ns"), b.alias("end_ns"), F.when(F.col("i") % 5 == 2, "").otherwise(F.col("label")).alias("lateral"), F.array(F.struct(e.alias("end_ns"), F.lit("cruising").alias("decision"))).alias("phases"))
    return stitch.scene_violations(rows).select(F.col("session_id").alias("sid"), F.col("start_ns").alias("start_us"), "rule")


@query("tx09_document")
def tx09(spark, sf):
    return stitch.session_documents(scenes(spark, sf), sessions(spark, sf))
