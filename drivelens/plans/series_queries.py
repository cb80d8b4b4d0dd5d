"""Queries on signals: joins by time, smoothing, events and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, intervals, series
from .lift import EVENTS, HOUR, NUMBERED, SESSION, STEP, events, numbered, read
from .registry import query

LEFT, RIGHT = "l AS (SELECT * FROM ev WHERE label <> 'purchase')", "r AS (SELECT sid, t, event_id AS rid, v AS rv FROM ev WHERE label = 'purchase')"
AGE = 24 * HOUR


def sides(spark, sf):
    e = events(spark, sf)
    return e.filter("label <> 'purchase'").select("sid", "event_id", "t"), e.filter("label = 'purchase'").select("sid", F.col("t").alias("rt"), F.col("event_id").alias("matched_id"), F.col("v").alias("rv"))


@query("jn04_asof", f"WITH {EVENTS}, {LEFT}, {RIGHT} SELECT l.sid, l.event_id, r.rid AS matched_id FROM l ASOF LEFT JOIN r ON l.sid = r.sid AND l.t >= r.t")
def jn04(spark, sf):
    left, right = sides(spark, sf)
    return asof.asof_backward(left, right, SESSION, "t", "rt", ["matched_id"]).select("sid", "event_id", "matched_id")


@query("jn05_asof_maxage", f"WITH {EVENTS}, {LEFT}, {RIGHT} SELECT l.sid, l.event_id, CASE WHEN l.t - r.t <= {AGE} THEN r.rid ELSE -1 END AS matched_id FROM l ASOF LEFT JOIN r ON l.sid = r.sid AND l.t >= r.t")
def jn05(spark, sf):
    left, right = sides(spark, sf)
    return asof.asof_backward(left, right, SESSION, "t", "rt", ["matched_id"], AGE, {"matched_id": -1}).select("sid", "event_id", "matched_id")


@query(
    "jn06_nearest",
    f"""WITH {EVENTS}, {LEFT}, {RIGHT}, p AS (SELECT l.sid, l.event_id, l.t, r.rid AS pid, l.t - r.t AS pd FROM l ASOF LEFT JOIN r ON l.sid = r.sid AND l.t >= r.t),
    n AS (SELECT l.event_id, r.rid AS nid, r.t - l.t AS nd FROM l ASOF LEFT JOIN r ON l.sid = r.sid AND l.t <= r.t),
    b AS (SELECT p.*, n.nid, n.nd, pid IS NOT NULL AND (nid IS NULL OR pd <= nd) AS back FROM p JOIN n USING (event_id))
    SELECT sid, event_id, CASE WHEN CASE WHEN back THEN pd ELSE nd END <= {AGE} THEN CASE WHEN back THEN pid ELSE nid END END AS matched_id FROM b""",
)
def jn06(spark, sf):
    left, right = sides(spark, sf)
    return asof.nearest(left, right, SESSION, "t", "rt", ["matched_id"], AGE).select("sid", "event_id", "matched_id")


GRID = f"""e AS (SELECT sid, min(t) AS a, max(t) AS b FROM ev GROUP BY sid), g AS (SELECT sid, i, a + i * {6 * HOUR} AS t FROM (SELECT *, unnest(range((b - a) // {6 * HOUR} + 1)) AS i FROM e)),
s AS (SELECT sid, t, v FROM ev), p AS (SELECT g.sid, g.i, g.t, s.t AS pt, s.v AS pv FROM g ASOF LEFT JOIN s ON g.sid = s.sid AND g.t >= s.t), n AS (SELECT g.sid, g.i, s.t AS nt, s.v AS nv FROM g ASOF LEFT JOIN s ON g.sid = s.sid AND g.t <= s.t),
j AS (SELECT p.*, n.nt, n.nv FROM p JOIN n USING (sid, i))"""


def on_grid(spark, sf):
    e = events(spark, sf)
    ends = e.groupBy("sid").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return asof.interpolate(asof.grid(ends, SESSION, 6 * HOUR), e.select("sid", F.col("t").alias("rt"), "v"), SESSION, "t", "rt", ["v"])


@query("jn08_interpolate", f"WITH {EVENTS}, {GRID} SELECT sid, CAST(i AS INTEGER) AS i, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt)::DOUBLE / (nt - pt)) END, 6) AS v FROM j")
def jn08(spark, sf):
    return on_grid(spark, sf).select("sid", "i", F.round("v", 6).alias("v"))


@query("flt04_valid", f"WITH {EVENTS}, {GRID} SELECT sid, CAST(i AS INTEGER) AS i, least(t - pt, nt - t) <= {2 * HOUR} AS valid FROM j")
def flt04(spark, sf):
    return on_grid(spark, sf).select("sid", "i", (F.col("gap") <= 2 * HOUR).alias("valid"))


@query("jn09_supported", f"WITH {EVENTS}, {GRID} SELECT sid, CAST(i AS INTEGER) AS i FROM j WHERE pt IS NOT NULL AND nt IS NOT NULL AND least(t - pt, nt - t) <= {4 * HOUR} AND (least(t - pt, nt - t) = 0 OR nt - pt <= {4 * HOUR})")
def jn09(spark, sf):
    return asof.supported(on_grid(spark, sf), 4 * HOUR).select("sid", "i")


@query("flt06_clock", f"WITH {EVENTS}, e AS (SELECT sid, min(t) AS a, max(t) AS b FROM ev GROUP BY sid), c AS (SELECT sid, CAST(ceil(a / {24 * HOUR}.0) AS BIGINT) AS lo, b // {24 * HOUR} AS hi FROM e) SELECT sid, unnest(range(lo, hi + 1)) * {24 * HOUR} AS t_us FROM c")
def flt06(spark, sf):
    ends = events(spark, sf).groupBy("sid").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return asof.clock(ends, SESSION, 24 * HOUR).withColumnRenamed("t", "t_us")


@query("flt03_grid_index", f"WITH {EVENTS}, e AS (SELECT sid, min(t) AS a FROM ev GROUP BY sid) SELECT event_id, CAST(round_even((t - a) / {6.0 * HOUR}, 0) AS BIGINT) AS i FROM ev JOIN e USING (sid)")
def flt03(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", asof.grid_index(F.col("t"), F.min("t").over(Window.partitionBy("sid")), 6 * HOUR).alias("i"))


@query("flt05_ranged", f"WITH {EVENTS}, e AS (SELECT sid, min(t) AS a FROM ev GROUP BY sid) SELECT sid, event_id FROM ev JOIN e USING (sid) WHERE t >= a + {48 * HOUR} AND t < a + {96 * HOUR}")
def flt05(spark, sf):
    start = F.min("t").over(Window.partitionBy("sid"))
    return events(spark, sf).withColumn("a", start).filter(f"t >= a + {48 * HOUR} and t < a + {96 * HOUR}").select("sid", "event_id")


def edge_mean(width: int) -> str:
    before, after = width // 2, width - 1 - width // 2
    return f"""(sum(v) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) + greatest(0, {before} - i) * first_value(v) OVER f + greatest(0, {after} - (n - 1 - i)) * last_value(v) OVER f) / {width}.0"""


@query("wn01_movavg", f"WITH {NUMBERED}, c AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM nu) SELECT sid, i, round({edge_mean(25)}, 6) AS odd, round({edge_mean(50)}, 6) AS even FROM c WINDOW f AS (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def wn01(spark, sf):
    rows = numbered(spark, sf)
    return rows.select("sid", "i", F.round(series.moving_average("v", SESSION, "i", 25), 6).alias("odd"), F.round(series.moving_average("v", SESSION, "i", 50), 6).alias("even"))


@query("wn02_gradient", f"WITH {NUMBERED} SELECT sid, i, round(coalesce((lead(v) OVER w - lag(v) OVER w) / 1.0, (lead(v) OVER w - v) / 0.5, (v - lag(v) OVER w) / 0.5), 6) AS value FROM nu WINDOW w AS (PARTITION BY sid ORDER BY i)")
def wn02(spark, sf):
    return numbered(spark, sf).select("sid", "i", F.round(series.gradient("v", SESSION, "i", 0.5), 6).alias("value"))


TAU = "6.283185307179586"


@query("wn03_unwrap", f"WITH {NUMBERED}, a AS (SELECT sid, i, v - floor((v + pi()) / {TAU}) * {TAU} AS y FROM nu), d AS (SELECT *, y - lag(y) OVER (PARTITION BY sid ORDER BY i) AS d FROM a), k AS (SELECT *, CASE WHEN abs(d) <= pi() OR d IS NULL THEN 0 ELSE ceil((d - pi()) / {TAU}) END AS k FROM d) SELECT sid, i, round(y - {TAU} * sum(k) OVER (PARTITION BY sid ORDER BY i), 6) AS value FROM k")
def wn03(spark, sf):
    rows = numbered(spark, sf).select("sid", "i", series.wrap(F.col("v")).alias("y"))
    return series.unwrap(rows, "y", SESSION, "i", "u").select("sid", "i", F.round("u", 6).alias("value"))


@query("wn04_cumlen", f"WITH {NUMBERED}, d AS (SELECT sid, i, coalesce(sqrt(pow(v - lag(v) OVER w, 2) + pow(k - lag(k) OVER w, 2)), 0) AS d FROM nu WINDOW w AS (PARTITION BY sid ORDER BY i)) SELECT sid, i, round(sum(d) OVER (PARTITION BY sid ORDER BY i), 4) AS value FROM d")
def wn04(spark, sf):
    rows = series.path_length(numbered(spark, sf), "v", "k", SESSION, "i", "s")
    return rows.select("sid", "i", F.round("s", 4).alias("value"))


@query(
    "wn10_hysteresis",
    f"""WITH {NUMBERED}, c AS (SELECT *, CASE WHEN v < 20 THEN 0 WHEN v > 60 THEN 1 END AS x FROM nu), m AS (SELECT sid, i, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY sid ORDER BY i), CASE WHEN first_value(v) OVER (PARTITION BY sid ORDER BY i) > 20 THEN 1 ELSE 0 END) = 1 AS moving FROM c),
    l AS (SELECT *, lag(moving) OVER (PARTITION BY sid ORDER BY i) AS was FROM m) SELECT sid, i, CASE WHEN moving THEN 'start' ELSE 'stop' END AS event FROM l WHERE was <> moving""",
)
def wn10(spark, sf):
    return series.stop_go(numbered(spark, sf), "v", SESSION, "i", 20, 60).filter("event is not null").select("sid", "i", "event")


@query("wn09_changes", f"WITH {EVENTS}, c AS (SELECT sid, event_id, label, lag(label) OVER (PARTITION BY sid ORDER BY t, event_id) AS previous FROM ev WHERE label <> 'error') SELECT * FROM c WHERE previous <> label")
def wn09(spark, sf):
    return series.changes(events(spark, sf), "label", SESSION, ["t", "event_id"], "error").select("sid", "event_id", "label", "previous")


@query("ag14_onset", f"WITH {NUMBERED}, c AS (SELECT sid, i, v, k, lag(v) OVER w AS pv, lag(k) OVER w AS pk FROM nu WINDOW w AS (PARTITION BY sid ORDER BY i)) SELECT sid, i FROM c WHERE pv >= 30 AND v < 30 AND k >= 10 AND pk >= 10")
def ag14(spark, sf):
    rows = numbered(spark, sf).withColumn("ok", F.col("k") >= 10)
    return series.onsets(rows, "v", SESSION, "i", 30, "ok").select("sid", "i")


@query(
    "ag12_speed_context",
    f"""WITH {NUMBERED} SELECT a.sid, a.i, round(max(b.v) FILTER (b.i = f) - 0, 6) AS w_from, round(max(b.v) FILTER (b.i = l), 6) AS w_to, round(max(b.v) FILTER (b.i = l) - max(b.v) FILTER (b.i = f), 6) AS w_change,
      min(b.v) AS w_min, arg_min(b.i, struct_pack(v := b.v, i := b.i)) AS w_min_at, max(b.v) AS w_max, arg_min(b.i, struct_pack(v := -b.v, i := b.i)) AS w_max_at, count(*) AS w_n
    FROM (SELECT sid, i, greatest(i - 10, 0) AS f, least(i + 10, max(i) OVER (PARTITION BY sid)) AS l FROM nu) a JOIN nu b ON a.sid = b.sid AND b.i BETWEEN a.i - 10 AND a.i + 10 GROUP BY a.sid, a.i""",
)
def ag12(spark, sf):
    rows = series.window_summary(numbered(spark, sf).select("sid", "i", "v"), "v", SESSION, "i", 10)
    return rows.select("sid", "i", *[F.round(c, 6).alias(c) for c in ("w_from", "w_to", "w_change")], "w_min", "w_min_at", "w_max", "w_max_at", "w_n")


@query(
    "wn22_longitudinal",
    f"""WITH {NUMBERED}, c AS (SELECT *, coalesce(lead(v, 4) OVER w, last_value(v) OVER f) - coalesce(lag(v, 4) OVER w, first_value(v) OVER f) AS g FROM nu
      WINDOW w AS (PARTITION BY sid ORDER BY i), f AS (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT sid, i, CASE WHEN v < 5 THEN 'stopped' WHEN k < 10 THEN 'hard_braking' WHEN g > 20 THEN 'accelerating' WHEN g < -20 THEN 'decelerating' ELSE 'cruising' END AS longitudinal FROM c""",
)
def wn22(spark, sf):
    return series.longitudinal(numbered(spark, sf), SESSION, "i", "v", "k", 4, 5, 20, 10).select("sid", "i", "longitudinal")


@query(
    "ag15_intersections",
    f"""WITH {NUMBERED}, c AS (SELECT *, label IN ('purchase', 'signup') AS ins, k >= 15 AS seen FROM nu), d AS (SELECT *, ins AND seen AS live, lag(ins AND seen) OVER w AS bl, lag(seen) OVER w AS bs, lead(ins AND seen) OVER w AS nl, lead(seen) OVER w AS ns FROM c WINDOW w AS (PARTITION BY sid ORDER BY i)),
    e AS (SELECT *, sum(CASE WHEN live AND NOT coalesce(bl, false) THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY i) AS g FROM d),
    v AS (SELECT sid, g, label, count(*) AS c, min(i) AS f FROM e WHERE live GROUP BY 1, 2, 3), b AS (SELECT sid, g, arg_min(label, struct_pack(c := -c, f := f)) AS mode FROM v GROUP BY 1, 2)
    SELECT sid, min(i) AS first, max(i) AS last, count(*) AS n, bool_or(NOT coalesce(bl, true) AND coalesce(bs, false)) AS entry_observed, bool_or(NOT coalesce(nl, true) AND coalesce(ns, false)) AS exit_observed, any_value(mode) AS mode FROM e JOIN b USING (sid, g) WHERE live GROUP BY sid, g""",
)
def ag15(spark, sf):
    return series.inside_spans(numbered(spark, sf), SESSION, "i", F.col("label").isin("purchase", "signup"), F.col("k") >= 15, "label")


@query(
    "ag16_departures",
    f"""WITH {NUMBERED}, c AS (SELECT sid, i, CASE WHEN k % 5 = 0 THEN NULL ELSE v > 60 END AS o FROM nu), d AS (SELECT *, lag(o) OVER w AS p, lead(o) OVER w AS nx, lead(i) OVER w AS ni FROM c WINDOW w AS (PARTITION BY sid ORDER BY i)),
    e AS (SELECT *, sum(CASE WHEN o AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY i) AS g FROM d)
    SELECT sid, min(i) AS first, max(i) AS last_outside, bool_or(coalesce(NOT p, false)) AS entry_observed, max(CASE WHEN NOT nx THEN ni END) AS returned FROM e WHERE o GROUP BY sid, g""",
)
def ag16(spark, sf):
    rows = numbered(spark, sf).withColumn("o", F.when(F.col("k") % 5 != 0, F.col("v") > 60))
    return series.departures(rows, SESSION, "i", "o")


@query("ag17_peaks", f"WITH {NUMBERED}, f AS (SELECT *, first_value(v) OVER (PARTITION BY sid ORDER BY i) AS v0 FROM nu) SELECT sid, max(v) AS peak, arg_min(i, struct_pack(v := -v, i := i)) AS peak_at, round(max(abs(v - v0)), 6) AS moved FROM f GROUP BY sid")
def ag17(spark, sf):
    rows = numbered(spark, sf).withColumn("v0", F.first("v").over(Window.partitionBy("sid").orderBy("i")))
    return rows.groupBy("sid").agg(F.max("v").alias("peak"), F.min(F.struct((-F.col("v")).alias("v"), "i"))["i"].alias("peak_at"), F.round(F.max(F.abs(F.col("v") - F.col("v0"))), 6).alias("moved"))


@query(
    "wn05_lights_ahead",
    f"""WITH {NUMBERED}, s AS (SELECT sid, i, k, sum(v) OVER (PARTITION BY sid ORDER BY i) AS s FROM nu), a AS (SELECT sid, i, s, last_value(CASE WHEN k % 9 = 0 THEN k END IGNORE NULLS) OVER w AS id, last_value(CASE WHEN k % 9 = 0 THEN s END IGNORE NULLS) OVER w AS sa FROM s WINDOW w AS (PARTITION BY sid ORDER BY i DESC))
    SELECT sid, i, CASE WHEN sa - s <= 150 THEN id END AS light FROM a""",
)
def wn05(spark, sf):
    w = Window.partitionBy("sid").orderBy("i")
    track = numbered(spark, sf).withColumn("s", F.sum("v").over(w)).withColumn("ids", F.when(F.col("k") % 9 == 0, F.array(F.col("k").cast("long"))).otherwise(F.array().cast("array<bigint>")))
    return series.lights_ahead(track, SESSION, "i", "ids", "s").select("sid", "i", F.try_element_at("ahead", F.lit(1)).cast("int").alias("light"))


@query("wn12_ticks", f"WITH {EVENTS}, e AS (SELECT sid, min(t) AS a, max(t) AS b FROM ev GROUP BY sid), x AS (SELECT sid, a AS t FROM e UNION SELECT sid, b FROM e UNION SELECT sid, unnest(range(CAST(ceil(a / {24.0 * HOUR}) AS BIGINT), b // {24 * HOUR} + 1)) * {24 * HOUR} FROM e) SELECT sid, t AS t_us FROM x")
def wn12(spark, sf):
    ends = events(spark, sf).groupBy("sid").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    first = F.col("start") + F.pmod(-F.col("start"), F.lit(24 * HOUR))
    regular = F.when(first <= F.col("end"), F.sequence(first, F.col("end"), F.lit(24 * HOUR).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return ends.select("sid", F.explode(F.array_distinct(F.concat(regular, F.array("start", "end")))).alias("t_us"))


@query(
    "wn13_stream_segments",
    f"""WITH {EVENTS}, sg AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY sid ORDER BY t, event_id) AS BIGINT) AS seg FROM
      (SELECT *, CASE WHEN 2 * (t - lag(t) OVER (PARTITION BY sid ORDER BY t, event_id)) > {3 * STEP} THEN 1 ELSE 0 END AS gap FROM ev))
    SELECT CAST(sid AS VARCHAR) AS sid, seg, count(*) AS n, min(t) AS start_us, max(t) AS end_us FROM sg GROUP BY ALL""",
)
def stream_segments(spark, sf):
    """The gap segments of events that arrive as a stream."""
    from ..streaming.segments import replayed

    rows = events(spark, sf).select(F.col("sid").alias("session_id"), (F.col("t") * 1000).alias("t_ns"))
    found = replayed(spark, rows, STEP * 1000)
    return found.select(F.col("session_id").alias("sid"), "seg", "n", F.expr("start_ns div 1000").alias("start_us"), F.expr("end_ns div 1000").alias("end_us"))


@query(
    "src17_last_wins",
    "WITH e AS (SELECT event_type AS key, user_id, event_id, value FROM events) SELECT key, user_id, arg_max(value, event_id) AS answer FROM e GROUP BY 1, 2",
)
def src17(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("key"), "user_id").agg(F.max(F.struct("event_id", "value"))["value"].alias("answer"))


@query("in01_cache_miss", "WITH e AS (SELECT event_id, event_type || '-' || user_id AS key FROM events), c AS (SELECT DISTINCT key FROM e WHERE event_id % 10 = 0) SELECT e.event_id, e.key, c.key IS NOT NULL AS hit FROM e LEFT JOIN c USING (key)")
def in01(spark, sf):
    from .inference import with_cache

    e = read(spark, sf, "events").select("event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"))
    cache = e.filter("event_id % 10 = 0").select("key", F.struct(F.lit("keep_lane").alias("lateral")).alias("answer"), F.col("event_id").alias("seq"))
    return with_cache(e, cache).select("event_id", "key", F.col("answer").isNotNull().alias("hit"))


@query("wn08_label_transitions", f"WITH {NUMBERED}, c AS (SELECT *, CASE WHEN k < 20 THEN 1 ELSE 0 END AS bad FROM nu), d AS (SELECT *, sum(bad) OVER (PARTITION BY sid ORDER BY i) AS part FROM c), e AS (SELECT sid, i, label, lag(label) OVER (PARTITION BY sid, part ORDER BY i) AS previous FROM d WHERE bad = 0) SELECT * FROM e WHERE previous <> label")
def wn08(spark, sf):
    # transitions start anew after every invalid sample
    part = F.sum((F.col("k") < 20).cast("int")).over(Window.partitionBy("sid").orderBy("i"))
    rows = numbered(spark, sf).withColumn("part", part).filter("k >= 20")
    return series.changes(rows, "label", ["sid", "part"], ["i"]).select("sid", "i", "label", "previous")


@query("wn25_route_context", f"WITH {NUMBERED}, s AS (SELECT sid, i, label, sum(v) OVER (PARTITION BY sid ORDER BY i) AS s FROM nu) SELECT sid, i, round(s - last_value(CASE WHEN label = 'purchase' THEN s END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY i), 4) AS since, round(first_value(CASE WHEN label = 'purchase' THEN s END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - s, 4) AS until FROM s")
def wn25(spark, sf):
    w = Window.partitionBy("sid").orderBy("i")
    rows = numbered(spark, sf).withColumn("s", F.sum("v").over(w)).withColumn("at", F.when(F.col("label") == "purchase", F.col("s")))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.select("sid", "i", F.round(F.col("s") - F.last("at", ignorenulls=True).over(w), 4).alias("since"), F.round(F.first("at", ignorenulls=True).over(ahead) - F.col("s"), 4).alias("until"))


@query("run_lengths", f"WITH {EVENTS}, r AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY sid ORDER BY t, event_id)), q AS (SELECT *, sum(c) OVER (PARTITION BY sid ORDER BY t, event_id) AS g FROM r), z AS (SELECT sid, g, label, count(*) AS n FROM q GROUP BY 1, 2, 3) SELECT label, n, count(*) AS runs FROM z GROUP BY 1, 2")
def run_lengths(spark, sf):
    return intervals.as_runs(events(spark, sf), SESSION, "t", "label", ["event_id"]).groupBy("label", "n").agg(F.count("*").alias("runs"))
