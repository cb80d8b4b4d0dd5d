"""Queries on objects, lanes and geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import geometry, lanes, objects
from . import lift
from .lift import LANES, NUMBERED, OBJECTS, numbered, read
from .registry import query


@query("jn01_equijoin4", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def jn01(spark, sf):
    t = lambda n: read(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("jn02_filter_join", "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 AND l_returnflag = 'R' GROUP BY 1")
def jn02(spark, sf):
    j = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(read(spark, sf, "supplier").filter("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("jn19_sessions_both", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT o_custkey FROM orders")
def jn19(spark, sf):
    return read(spark, sf, "events").filter("event_type = 'error'").select("user_id").intersect(read(spark, sf, "orders").select("o_custkey"))


@query("jn25_missing_roles", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 45)")
def jn25(spark, sf):
    used = read(spark, sf, "lineitem").filter("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("jn26_nearest_script", "SELECT user_id, arg_min(event_id, struct_pack(d := abs(value - 50), i := event_id)) AS event_id FROM events GROUP BY 1")
def jn26(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.min(F.struct(F.abs(F.col("value") - 50).alias("d"), "event_id"))["event_id"].alias("event_id"))


@query("st01_union", "SELECT key, count(*) AS n, sum(v) AS total FROM (SELECT n_nationkey AS key, 1 AS v FROM nation UNION ALL SELECT c_nationkey, 2 FROM customer UNION ALL SELECT s_nationkey, 3 FROM supplier) GROUP BY key".replace("sum(v)", "CAST(sum(v) AS BIGINT)"))
def st01(spark, sf):
    part = lambda t, c, v: read(spark, sf, t).select(F.col(c).alias("key"), F.lit(v).alias("v"))
    return part("nation", "n_nationkey", 1).unionByName(part("customer", "c_nationkey", 2)).unionByName(part("supplier", "s_nationkey", 3)).groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("st02_intersect", "SELECT user_id AS sid FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 300")
def st02(spark, sf):
    e = read(spark, sf, "events").withColumnRenamed("user_id", "sid")
    return e.filter("event_type = 'purchase'").select("sid").intersect(e.filter("event_type = 'error' and value > 300").select("sid"))


@query("st03_except", "(SELECT 'declared' AS side, c_custkey AS id FROM customer EXCEPT SELECT 'declared', o_custkey FROM orders) UNION ALL (SELECT 'present', o_custkey FROM orders EXCEPT SELECT 'present', c_custkey FROM customer WHERE c_acctbal > 0)")
def st03(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    declared = c.select(F.col("c_custkey").alias("id")).subtract(o).select(F.lit("declared").alias("side"), "id")
    return declared.unionByName(o.subtract(c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))).select(F.lit("present").alias("side"), "id"))


@query("st04_distinct_order", "WITH r AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, '>' ORDER BY f) AS roles FROM r GROUP BY 1")
def st04(spark, sf):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(listed), ">").alias("roles"))


@query("st05_disjoint", "SELECT count(*) AS shared FROM (SELECT n_nationkey FROM nation INTERSECT SELECT r_regionkey FROM region)")
def st05(spark, sf):
    shared = read(spark, sf, "nation").select("n_nationkey").intersect(read(spark, sf, "region").select("r_regionkey"))
    return shared.agg(F.count("*").alias("shared"))


@query("st06_dups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def st06(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


def near(spark, sf):
    o = objects.believable(lift.objects(spark, sf))
    return o.withColumn("distance", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))


@query("flt01_existence", f"WITH {OBJECTS} SELECT now, count(*) AS n FROM near GROUP BY now")
def flt01(spark, sf):
    return near(spark, sf).groupBy("now").agg(F.count("*").alias("n"))


@query("flt02_radius", f"WITH {OBJECTS} SELECT now, t, frame, line, pos, round(distance, 6) AS distance FROM near WHERE distance <= 20")
def flt02(spark, sf):
    return objects.within(objects.believable(lift.objects(spark, sf)), radius=20).select("now", "t", "frame", "line", "pos", F.round("distance", 6).alias("distance"))


FIRST = "fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY now, t, track ORDER BY frame, line, pos) AS r FROM near WHERE track IS NOT NULL) WHERE r = 1)"
TRACKS = f"""{FIRST}, tr AS (SELECT now, track, arg_min(kind, struct_pack(t := t, f := frame, l := line, p := pos)) AS kind, count(*) AS n, min(distance) AS min_distance, min(t) AS first, max(t) AS last FROM fi GROUP BY 1, 2 HAVING min(distance) <= 30)"""


def tracked(spark, sf):
    return objects.tracks(near(spark, sf), ["now"], "t", "track", "kind", ["frame", "line", "pos"])


@query("ag18_tracks", f"WITH {OBJECTS}, {TRACKS} SELECT now, track, kind, n, round(min_distance, 6) AS min_distance, first, last FROM tr")
def ag18(spark, sf):
    return tracked(spark, sf).withColumn("min_distance", F.round("min_distance", 6))


@query("ag19_missing_ids", f"WITH {OBJECTS} SELECT now, bool_or(track IS NULL AND distance <= 30) AS ids_missing FROM near GROUP BY now")
def ag19(spark, sf):
    return objects.missing_ids(near(spark, sf), ["now"], "track")


TIER = "CASE WHEN kind = 'R' AND n > 1 AND min_distance < 10 THEN 0 WHEN min_distance < 3 THEN 1 ELSE 2 END"


@query("tk01_top8", f"WITH {OBJECTS}, {TRACKS}, rk AS (SELECT *, {TIER} AS tier, row_number() OVER (PARTITION BY now ORDER BY {TIER}, round(min_distance, 9), track) AS rank, count(*) OVER (PARTITION BY now) AS total FROM tr) SELECT now, CAST(rank AS INTEGER) AS rank, track, tier, total, greatest(total - 8, 0) AS omitted FROM rk WHERE rank <= 8")
def tk01(spark, sf):
    found = tracked(spark, sf).withColumn("tier", objects.tier(F.col("kind") == "R", F.col("n") > 1, F.col("min_distance") < 10, F.col("min_distance")))
    return objects.top_tracks(found, ["now"], ["tier", F.round("min_distance", 9), "track"]).select("now", "rank", "track", "tier", "total", "omitted")


@query("tk02_map_free", f"WITH {OBJECTS}, {TRACKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY round(min_distance, 9), track) AS rank FROM tr) SELECT now, CAST(rank AS INTEGER) AS rank, track FROM rk WHERE rank <= 8")
def tk02(spark, sf):
    return objects.top_tracks(tracked(spark, sf), ["now"], [F.round("min_distance", 9), "track"]).select("now", "rank", "track")


@query("tk03_nearest", f"WITH {OBJECTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY track IS NULL, round(distance, 9), line, pos) AS rank FROM near WHERE distance <= 30) SELECT frame, CAST(rank AS INTEGER) AS rank, line, pos, track FROM rk WHERE rank <= 3")
def tk03(spark, sf):
    ranked = objects.top_tracks(near(spark, sf).filter("distance <= 30"), ["frame"], [F.col("track").isNull(), F.round("distance", 9), "line", "pos"], 3)
    return ranked.select("frame", "rank", "line", F.col("pos").cast("long").alias("pos"), "track")


@query("wn26_key_observations", f"""WITH {OBJECTS}, {FIRST}, a AS (
  SELECT now, track, t, 0 AS o, 'closest' AS nm FROM (SELECT *, row_number() OVER (PARTITION BY now, track ORDER BY distance, t) AS q FROM fi) WHERE q = 1
  UNION ALL SELECT now, track, t, 1, 'first' FROM (SELECT *, row_number() OVER (PARTITION BY now, track ORDER BY t) AS q FROM fi) WHERE q = 1
  UNION ALL SELECT now, track, t, 2, 'last' FROM (SELECT *, row_number() OVER (PARTITION BY now, track ORDER BY t DESC) AS q FROM fi) WHERE q = 1),
  m AS (SELECT now, track, t, min(o) AS o, string_agg(nm, '+' ORDER BY o, nm) AS reasons FROM a GROUP BY 1, 2, 3),
  z AS (SELECT *, row_number() OVER (PARTITION BY now, track ORDER BY o) AS q FROM m) SELECT now, track, t, reasons FROM z WHERE q <= 2""")
def wn26(spark, sf):
    seen = objects.first_sightings(near(spark, sf), ["now"], "t", "track", ["frame", "line", "pos"]).select("now", "track", "t", "distance")
    found = objects.key_observations(seen, ["now", "track"], "t", "distance", {"closest": F.col("distance"), "first": F.col("t"), "last": -F.col("t")}, 2)
    return found.select("now", "track", "t", F.array_join("reasons", "+").alias("reasons"))


@query("fn03_rotate", "SELECT event_id, round(value * cos(user_id) + event_id % 7 * sin(user_id), 6) AS ahead, round(-value * sin(user_id) + event_id % 7 * cos(user_id), 6) AS left_of FROM events")
def fn03(spark, sf):
    e = read(spark, sf, "events")
    ahead, left = objects.ego_frame(F.col("value"), (F.col("event_id") % 7).cast("double"), F.col("user_id").cast("double"))
    return e.select("event_id", F.round(ahead, 6).alias("ahead"), F.round(left, 6).alias("left_of"))


RELATIONS = f"""{LANES}, ah AS (SELECT id AS a, f AS b FROM ln), bk AS (SELECT id AS a, p AS b FROM ln),
ed AS (SELECT id AS a, id AS b, 0 AS o, 'same' AS relation FROM ln UNION ALL SELECT a, b, 1, 'following' FROM ah UNION ALL SELECT a, b, 2, 'previous' FROM bk UNION ALL SELECT id, l, 3, 'left' FROM ln UNION ALL SELECT id, r, 4, 'right' FROM ln
  UNION ALL SELECT x.a, y.b, 5, 'near' FROM ah x JOIN ah y ON x.b = y.a UNION ALL SELECT x.a, y.b, 5, 'near' FROM bk x JOIN bk y ON x.b = y.a),
rl AS (SELECT a, b, arg_min(relation, o) AS relation FROM ed WHERE b IS NOT NULL GROUP BY a, b)"""


@query("jn22_relation", f"WITH {RELATIONS}, x AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS a, CAST(c_custkey % 25 AS BIGINT) AS b FROM customer) SELECT x.a, x.b, coalesce(rl.relation, 'other') AS relation FROM x LEFT JOIN rl USING (a, b)")
def jn22(spark, sf):
    pairs = read(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).cast("long").alias("b")).distinct()
    return lanes.relate(pairs, lanes.relations(lift.lanes(spark, sf)))


@query("jn23_closure", f"WITH RECURSIVE {LANES}, sd AS (SELECT id, l AS b FROM ln WHERE l IS NOT NULL UNION SELECT id, r FROM ln WHERE r IS NOT NULL), c(seed, id) AS (SELECT id, id FROM ln UNION SELECT c.seed, sd.b FROM c JOIN sd ON sd.id = c.id) SELECT seed, id FROM c")
def jn23(spark, sf):
    _checkpoints(spark)
    table = lift.lanes(spark, sf)
    return lanes.closure(table, table.select("id"))


def _checkpoints(spark) -> None:
    if not spark.sparkContext.getCheckpointDir():
        from ..streaming.segments import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@query("jn24_chain", f"WITH RECURSIVE {LANES}, c(id, tip, hops, added, chain) AS (SELECT id, id, 0, CAST(0 AS DOUBLE), [id] FROM ln UNION ALL SELECT c.id, ln.f, hops + 1, added + n.len, list_append(chain, ln.f) FROM c JOIN ln ON ln.id = c.tip JOIN ln n ON n.id = ln.f WHERE hops < 8 AND added < 5 AND NOT list_contains(chain, ln.f)), m AS (SELECT id, max(hops) AS h FROM c GROUP BY id) SELECT c.id, array_to_string(chain, '-') AS chain FROM c JOIN m ON m.id = c.id AND m.h = c.hops")
def jn24(spark, sf):
    return lanes.chains(lift.lanes(spark, sf)).select("id", F.array_join(F.transform("chain", lambda x: x.cast("string")), "-").alias("chain"))


def polylines(spark, sf):
    """Embeddings as lines of their first four pairs, and their last two components and label as poses."""
    e = read(spark, sf, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double") * 10
    return e.select(F.col("vec_id").alias("id"), F.array(*[F.struct((at(2 * k) + 10 * k).alias("x"), at(2 * k + 1).alias("y")) for k in range(4)]).alias("centerline"), (at(62) + 15).alias("x"), at(63).alias("y"), (at(61) / 10).alias("yaw"))


SEGMENT = """pl AS (SELECT vec_id AS id, [embedding[1]::DOUBLE * 10, embedding[3]::DOUBLE * 10 + 10, embedding[5]::DOUBLE * 10 + 20, embedding[7]::DOUBLE * 10 + 30] AS xs, [embedding[2]::DOUBLE * 10, embedding[4]::DOUBLE * 10, embedding[6]::DOUBLE * 10, embedding[8]::DOUBLE * 10] AS ys,
  embedding[63]::DOUBLE * 10 + 15 AS x, embedding[64]::DOUBLE * 10 AS y, embedding[62]::DOUBLE * 10 / 10 AS yaw FROM embeddings),
sg AS (SELECT id, k, x, y, yaw, xs[k] AS ax, ys[k] AS ay, xs[k + 1] - xs[k] AS dx, ys[k + 1] - ys[k] AS dy FROM (SELECT *, unnest([1, 2, 3]) AS k FROM pl)),
sf AS (SELECT *, least(greatest(((x - ax) * dx + (y - ay) * dy) / greatest(dx * dx + dy * dy, 1e-12), 0), 1) AS u FROM sg),
dd AS (SELECT *, pow(x - ax - u * dx, 2) + pow(y - ay - u * dy, 2) AS d2 FROM sf), be AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS r FROM dd)"""


@query("ge01_project", f"WITH {SEGMENT} SELECT id, round(sqrt(d2) * CASE WHEN dx * (y - ay) - dy * (x - ax) < 0 THEN -1 ELSE 1 END, 6) AS offset_m, round(yaw - atan2(dy, dx) + pi() - floor((yaw - atan2(dy, dx) + pi()) / (2 * pi())) * 2 * pi() - pi(), 6) AS heading FROM be WHERE r = 1")
def ge01(spark, sf):
    def run(batches):
        for rows in batches:
            out = []
            for i, line, x, y, yaw in zip(rows["id"], rows["centerline"], rows["x"], rows["y"], rows["yaw"], strict=True):
                offset, diff, _ = lanes.project(np.array([[p["x"], p["y"]] for p in line]), np.array([x]), np.array([y]), np.array([yaw]))
                out.append((i, round(float(offset[0]), 6), round(float(diff[0]), 6)))
            yield pd.DataFrame(out, columns=["id", "offset_m", "heading"])

    return polylines(spark, sf).mapInPandas(run, "id long, offset_m double, heading double")


BOXES = """bx AS (SELECT l_orderkey AS frame, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos, l_quantity AS x, l_discount * 100 AS y, 1 + l_tax * 50 AS w FROM lineitem)"""


def boxes(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"), F.row_number().over(w).alias("pos"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (1 + F.col("l_tax") * 50).alias("w"))


def _bodies(rows: pd.DataFrame) -> np.ndarray:
    x, y, w = (rows[c].to_numpy(float) for c in ("x", "y", "w"))
    return geometry.rectangles(x, y, np.zeros(len(rows)), np.full(len(rows), 4.0), w)


@query("ge05_share", f"WITH {BOXES} SELECT frame, line, pos, round(greatest(least(x + 2, 30) - greatest(x - 2, 10), 0) * greatest(least(y + w / 2, 6) - greatest(y - w / 2, 2), 0) / (4 * w), 6) AS share FROM bx")
def ge05(spark, sf):
    lane = np.array([(10.0, 2.0), (30.0, 2.0), (30.0, 6.0), (10.0, 6.0)])

    def run(batches):
        for rows in batches:
            share = geometry.overlap_areas(lane, _bodies(rows)) / (4 * rows["w"].to_numpy())
            yield rows[["frame", "line", "pos"]].assign(share=np.round(share, 6))

    return boxes(spark, sf).mapInPandas(run, "frame long, line int, pos long, share double")


@query("ge02_rect", f"WITH {BOXES} SELECT frame, line, pos, round(x + 2 * cos(y) - w / 2 * sin(y), 6) AS x0, round(y + 2 * sin(y) + w / 2 * cos(y), 6) AS y0, round(x - 2 * cos(y) + w / 2 * sin(y), 6) AS x2 FROM bx WHERE w > 1.5")
def ge02(spark, sf):
    corners = geometry.rectangle_column(F.col("x"), F.col("y"), F.col("y"), F.lit(4.0), F.when(F.col("w") > 1.5, F.col("w")))
    return boxes(spark, sf).withColumn("c", corners).filter("c is not null").select("frame", "line", F.col("pos").cast("long").alias("pos"), F.round(F.col("c")[0]["x"], 6).alias("x0"), F.round(F.col("c")[0]["y"], 6).alias("y0"), F.round(F.col("c")[2]["x"], 6).alias("x2"))


@query("ge07_clearance", f"WITH {BOXES}, d AS (SELECT *, greatest(abs(x - 20) - 4, 0) AS gx, greatest(abs(y - 4) - w / 2 - 1, 0) AS gy FROM bx) SELECT frame, line, pos, round(sqrt(gx * gx + gy * gy), 6) AS clearance FROM d")
def ge07(spark, sf):
    ego = geometry.rectangle(20.0, 4.0, 0.0, 4.0, 2.0)

    def run(batches):
        for rows in batches:
            far = geometry.clearances(_bodies(rows), ego)
            yield rows[["frame", "line", "pos"]].assign(clearance=np.round(far, 6))

    return boxes(spark, sf).mapInPandas(run, "frame long, line int, pos long, clearance double")


@query("jn10_within", f"WITH {SEGMENT}, po AS (SELECT vec_id AS pose, embedding[63]::DOUBLE * 10 + 15 AS px, embedding[64]::DOUBLE * 10 AS py FROM embeddings), sx AS (SELECT DISTINCT id, k, ax, ay, dx, dy FROM sg), q AS (SELECT pose, id, least(greatest(((px - ax) * dx + (py - ay) * dy) / greatest(dx * dx + dy * dy, 1e-12), 0), 1) AS u, px, py, ax, ay, dx, dy FROM po CROSS JOIN sx), z AS (SELECT pose, id, min(sqrt(pow(px - ax - u * dx, 2) + pow(py - ay - u * dy, 2))) AS d FROM q GROUP BY 1, 2) SELECT pose AS pose_id, id AS lane_id, round(d, 6) AS distance FROM z WHERE d <= 1")
def jn10(spark, sf):
    rows = polylines(spark, sf)
    poses = rows.select(F.col("id").alias("pose_id"), "x", "y", F.lit(0.0).alias("yaw"))
    table = rows.select("id", "centerline", F.lit(None).cast("array<struct<x:double,y:double>>").alias("polygon"))
    return lanes.candidates(poses, table, 1.0, 4.0, 5.0).select("pose_id", "lane_id", scalars.millionths(F.col("distance")).alias("distance"))


def lane_track(spark, sf):
    """Events as poses whose candidates are three nations by the hundredths, at costs of their values."""
    n = numbered(spark, sf)
    found = n.select("sid", F.col("i").alias("k"), F.explode(F.array(*[((F.col("k") + s) % 25).cast("long") for s in (0, 5, 11)])).alias("lane_id"), "v").withColumn("cost", F.col("v") / 50 + (F.col("lane_id") % 5) / 4)
    return n.select("sid", F.col("i").alias("k"), (F.col("k") >= 5).alias("valid")), found.drop("v")


# one step of the decoding a round: each state keeps the path by which it is cheapest, the first of equals
VITERBI = f"""WITH RECURSIVE {RELATIONS}, {NUMBERED[len('ev AS') - 5:]},
co AS (SELECT sid, i AS k, CAST((k + s) % 25 AS BIGINT) AS lane, v / 50 + (CAST((k + s) % 25 AS BIGINT) % 5) / 4 AS c FROM nu CROSS JOIN (SELECT unnest([0, 5, 11]) AS s) WHERE k >= 5),
st AS (SELECT sid, k, lane, c, row_number() OVER (PARTITION BY sid, k ORDER BY lane, c) AS s FROM co UNION ALL SELECT sid, i, NULL, CASE WHEN k >= 5 THEN 3.0 ELSE 0.0 END, 99 FROM nu),
tr(relation, cost) AS (VALUES ('same', 0.0), ('following', 0.3), ('previous', 0.3), ('near', 0.6), ('left', 1.0), ('right', 1.0), ('other', 5.0)),
mv AS (SELECT a.id AS a, b.id AS b, tr.cost FROM ln a CROSS JOIN ln b LEFT JOIN rl ON rl.a = a.id AND rl.b = b.id JOIN tr ON tr.relation = coalesce(rl.relation, 'other')),
dp(sid, k, lane, s, cost, path) AS (SELECT sid, k, lane, s, CAST(c AS DOUBLE), [lane] FROM st WHERE k = 0
  UNION ALL SELECT sid, k, lane, s, cost + c, list_append(path, lane) FROM (
    SELECT st.sid, st.k, st.lane, st.s, st.c, dp.path, dp.cost + CASE WHEN dp.lane IS NULL AND st.lane IS NULL THEN 0.0 WHEN dp.lane IS NULL OR st.lane IS NULL THEN 2.0 ELSE mv.cost END AS cost,
      row_number() OVER (PARTITION BY st.sid, st.s ORDER BY dp.cost + CASE WHEN dp.lane IS NULL AND st.lane IS NULL THEN 0.0 WHEN dp.lane IS NULL OR st.lane IS NULL THEN 2.0 ELSE mv.cost END, dp.s) AS r
    FROM dp JOIN st ON st.sid = dp.sid AND st.k = dp.k + 1 LEFT JOIN mv ON mv.a = dp.lane AND mv.b = st.lane) WHERE r = 1),
en AS (SELECT sid, path, row_number() OVER (PARTITION BY sid ORDER BY cost, s) AS r FROM dp WHERE k = (SELECT max(n.i) FROM nu n WHERE n.sid = dp.sid))
SELECT sid, CAST(unnest(range(len(path))) AS INTEGER) AS k, unnest(path) AS lane_id FROM en WHERE r = 1"""


@query("wn19_viterbi", VITERBI)
def wn19(spark, sf):
    track, found = lane_track(spark, sf)
    return lanes.match_track(track, found, lanes.relations(lift.lanes(spark, sf)), ["sid"])


@query("wn08_lane_changes", f"WITH {RELATIONS}, {NUMBERED[len('ev AS') - 5:]}, c AS (SELECT sid, i, CAST(k % 25 AS BIGINT) AS b, CAST(lag(k) OVER (PARTITION BY sid ORDER BY i) % 25 AS BIGINT) AS a FROM nu) SELECT c.sid, c.i, c.a, c.b, coalesce(rl.relation, 'other') AS relation FROM c LEFT JOIN rl USING (a, b) WHERE a <> b")
def wn08(spark, sf):
    track = numbered(spark, sf).select("sid", "i", (F.col("k") % 25).cast("long").alias("lane_id"))
    return lanes.lane_changes(track, lanes.relations(lift.lanes(spark, sf)), ["sid"], "i").select("sid", "i", "a", "b", "relation")


@query("tk05_best_lane", f"WITH {NUMBERED}, f AS (SELECT sid, i, k, v, CAST((k + s) % 25 AS BIGINT) AS lane_id FROM nu CROSS JOIN (SELECT unnest([0, 5, 11]) AS s)), r AS (SELECT *, row_number() OVER (PARTITION BY sid, i ORDER BY v / 50 + (lane_id % 5) / 4.0, lane_id) AS r FROM f) SELECT sid, i AS k, lane_id FROM r WHERE r = 1")
def tk05(spark, sf):
    return lanes.best_lane(lane_track(spark, sf)[1], ["sid", "k"]).select("sid", "k", "lane_id")
