"""Queries on scalar functions and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import series
from .lift import read
from .registry import query


@query("fn01_yaw", "SELECT event_id, round(atan2(2 * (cos(value) * sin(value)), 1 - 2 * sin(value) * sin(value)), 6) AS yaw FROM events")
def fn01(spark, sf):
    zero = F.lit(0.0)
    return read(spark, sf, "events").select("event_id", F.round(scalars.quaternion_yaw(F.cos("value"), zero, zero, F.sin("value")), 6).alias("yaw"))


@query("fn02_wrap", "SELECT event_id, round(value + pi() - floor((value + pi()) / (2 * pi())) * (2 * pi()) - pi(), 6) AS angle FROM events")
def fn02(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(series.wrap(F.col("value")), 6).alias("angle"))


@query("fn04_speed", "SELECT event_id, round(sqrt(value * value + user_id * user_id), 6) AS speed FROM events")
def fn04(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(scalars.speed(F.col("value"), F.col("user_id").cast("double")), 6).alias("speed"))


@query(
    "fn05_turn",
    """WITH p AS (SELECT vec_id, [embedding[2 * k + 1]::DOUBLE + k FOR k IN range(8)] AS xs, [embedding[2 * k + 2]::DOUBLE + k * k * (vec_id % 5 - 2) / 12.0 FOR k IN range(8)] AS ys FROM embeddings),
    h AS (SELECT vec_id, atan2(ys[8] - ys[5], xs[8] - xs[5]) - atan2(ys[4] - ys[1], xs[4] - xs[1]) AS d FROM p), w AS (SELECT vec_id, degrees(d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi()) AS t FROM h)
    SELECT vec_id, CASE WHEN abs(t) > 135 THEN 'u-turn' WHEN abs(t) < 30 THEN 'straight' WHEN t > 0 THEN 'left' ELSE 'right' END AS turn FROM w""",
)
def fn05(spark, sf):
    e = read(spark, sf, "embeddings")
    bend = (F.col("vec_id") % 5 - 2) / 12.0
    points = F.array(*[F.struct((F.col("embedding")[2 * k].cast("double") + k).alias("x"), (F.col("embedding")[2 * k + 1].cast("double") + k * k * bend).alias("y")) for k in range(8)])
    return e.select("vec_id", scalars.turn_direction(points).alias("turn"))


@query("fn07_round", "SELECT event_id, round_even((event_id % 1000) / 8.0::DOUBLE - 60, 1) + 0.0 AS rounded FROM events")
def fn07(spark, sf):
    return read(spark, sf, "events").select("event_id", scalars.rounded((F.col("event_id") % 1000) / 8.0 - 60, 1).alias("rounded"))


@query("fn08_alias", "SELECT DISTINCT user_id, repeat(chr(CAST(65 + user_id % 26 AS INTEGER)), CAST(user_id // 26 + 1 AS INTEGER)) AS alias FROM events")
def fn08(spark, sf):
    return read(spark, sf, "events").select("user_id").distinct().select("user_id", scalars.alias_letters(F.col("user_id")).alias("alias"))


@query("fn09_alias26", "SELECT DISTINCT user_id, CASE WHEN user_id < 26 THEN chr(CAST(65 + user_id AS INTEGER)) ELSE chr(CAST(64 + user_id // 26 AS INTEGER)) || chr(CAST(65 + user_id % 26 AS INTEGER)) END AS alias FROM events")
def fn09(spark, sf):
    return read(spark, sf, "events").select("user_id").distinct().select("user_id", scalars.alias_base26(F.col("user_id")).alias("alias"))


@query("fn13_share", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CASE WHEN l_discount > 0 THEN least(greatest(100 * l_tax / l_discount, 0), 100) END, 6) AS share FROM lineitem")
def fn13(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(scalars.percent(F.col("l_tax"), F.col("l_discount")), 6).alias("share"))


@query("fn17_defaults", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 1.0) AS existence, CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'bus' ELSE 'object' END AS kind FROM events")
def fn17(spark, sf):
    kinds = F.create_map(F.lit("click"), F.lit("car"), F.lit("view"), F.lit("bus"))
    return read(spark, sf, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("value")), F.lit(1.0)).alias("existence"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("object")).alias("kind"))


@query("fn10_cache_key", """SELECT conv_id, turn, sha256('{"model": "default", "questions": {"lateral": ["a", "b"]}, "state": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}') AS key FROM conversations""")
def fn10(spark, sf):
    none = F.lit(None).cast("string")
    return read(spark, sf, "conversations").select("conv_id", "turn", scalars.cache_key_column(F.lit('{"lateral": ["a", "b"]}'), F.coalesce("text", F.lit("")), none, none, none, none).alias("key"))


@query("fn12_parse", r"SELECT conv_id, turn, role, regexp_extract(text, '([A-Za-z]+)[,.] ([A-Za-z]+)', 1) AS before, regexp_extract(text, '([A-Za-z]+)[,.] ([A-Za-z]+)', 2) AS after FROM conversations")
def fn12(spark, sf):
    pattern = "([A-Za-z]+)[,.] ([A-Za-z]+)"
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_extract("text", pattern, 1).alias("before"), F.regexp_extract("text", pattern, 2).alias("after"))


@query("src06_light_text", "SELECT user_id, coalesce(nullif(array_to_string(list_concat(list_sort(list_distinct(list(event_type) FILTER (event_type IN ('view', 'click')))), list_sort(list_distinct(list(event_type) FILTER (event_type = 'error')))), ' + '), ''), 'none') AS light FROM events WHERE value > 200 GROUP BY user_id".replace("list_concat(", "list_concat(").replace("FILTER (event_type IN ('view', 'click'))", "FILTER (event_type IN ('view', 'click'))"))
def src06(spark, sf):
    e = read(spark, sf, "events").filter("value > 200")
    pick = lambda c: F.collect_list(F.when(c, F.col("event_type")))
    sides = e.groupBy("user_id").agg(pick(F.col("event_type").isin("view", "click")).alias("circles"), pick(F.col("event_type") == "error").alias("arrows"))
    return sides.select("user_id", scalars.light_text(F.col("circles"), F.col("arrows")).alias("light"))


@query("ag20_token_totals", "SELECT role, count(*) AS fresh, CAST(sum(length(text) // 4) AS BIGINT) AS input_tokens, round(sum(length(text) // 4) * 0.042 / 1e6, 9) AS cost_usd FROM conversations GROUP BY role")
def ag20(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("tokens", F.floor(F.length("text") / 4))
    return rows.groupBy("role").agg(F.count("*").alias("fresh"), F.sum("tokens").alias("input_tokens"), F.round(F.sum("tokens") * 0.042 / 1e6, 9).alias("cost_usd"))


@query("flt10_review_state", "SELECT event_id, CASE WHEN value BETWEEN 100 AND 150 THEN 'core' WHEN value BETWEEN 90 AND 160 THEN 'margin' ELSE 'none' END AS state FROM events")
def flt10(spark, sf):
    from ..operators.review import state

    return read(spark, sf, "events").select("event_id", state(F.col("value"), F.lit(100.0), F.lit(150.0), F.lit(10.0)).alias("state"))
