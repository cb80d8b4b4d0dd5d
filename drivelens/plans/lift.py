"""Sessions, steps, signals and lanes made from the test tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals

HOUR = 3_600_000_000
STEP = 6 * HOUR
HALF = STEP // 2
SESSION = ["sid"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str) -> F.Column:
    # TIMESTAMP_NTZ has no unix_micros; the difference to the epoch does not depend on a time zone
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").select(F.col("user_id").alias("sid"), micros("ts").alias("t"), "event_id", F.col("event_type").alias("label"), (k / 100.0).alias("p"), k.alias("k"), F.col("value").alias("v"))


EVENTS = """ev AS (SELECT user_id AS sid, epoch_us(ts) AS t, event_id, event_type AS label, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p, value AS v FROM events)"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their place in the session, from 0."""
    from pyspark.sql import Window

    return events(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("sid").orderBy("t", "event_id")) - 1)


NUMBERED = EVENTS + ", nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY sid ORDER BY t, event_id) - 1 AS INTEGER) AS i FROM ev)"


def spans(rows: DataFrame, shift: int = 0) -> DataFrame:
    """sid, i, start, end, label: each run until the next one begins, the last for a step."""
    from pyspark.sql import Window

    runs = intervals.as_runs(rows, SESSION, "t", "label", ["event_id"])
    end = F.coalesce(F.lead("first").over(Window.partitionBy("sid").orderBy("run")), F.col("last") + STEP)
    return runs.select("sid", F.col("run").alias("i"), (F.col("first") + shift).alias("start"), (end + shift).alias("end"), "label")


def runs_sql(name: str, source: str, where: str = "true") -> str:
    return f"""{name}_a AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS c FROM {source} WHERE {where} WINDOW w AS (PARTITION BY sid ORDER BY t, event_id)),
{name}_b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY sid ORDER BY t, event_id) AS BIGINT) AS run FROM {name}_a),
{name}_r AS (SELECT sid, run, label, min(t) AS first, max(t) AS last, count(*) AS n, avg(p) AS mean_p FROM {name}_b GROUP BY sid, run, label)"""


def spans_sql(name: str, source: str, shift: int = 0, where: str = "true") -> str:
    return f"""{runs_sql(name, source, where)},
{name} AS (SELECT sid, run AS i, first + {shift} AS a, coalesce(lead(first) OVER (PARTITION BY sid ORDER BY run), last + {STEP}) + {shift} AS b, label FROM {name}_r)"""


SHIFT = HOUR // 2


def truth(spark, sf) -> DataFrame:
    return spans(events(spark, sf))


def candidate(spark, sf) -> DataFrame:
    return spans(events(spark, sf).filter("k >= 40"), SHIFT)


BOTH = f"WITH {EVENTS},\n{spans_sql('gt', 'ev')},\n{spans_sql('rn', 'ev', SHIFT, 'k >= 40')}"


def lanes(spark, sf) -> DataFrame:
    """Nations as lanes: neighbours by key within a region, one continuation five keys on."""
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lag(F.col("n_nationkey").cast("long")).over(w).alias("left"), F.lead(F.col("n_nationkey").cast("long")).over(w).alias("right"))
    return n.select("id", "left", "right", F.array((F.col("id") + 5) % 25).alias("following"), F.array((F.col("id") + 20) % 25).alias("previous"), (F.col("id") % 4 + 1).cast("double").alias("length"))


LANES = """ln AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(lag(n_nationkey) OVER w AS BIGINT) AS l, CAST(lead(n_nationkey) OVER w AS BIGINT) AS r,
  CAST((n_nationkey + 5) % 25 AS BIGINT) AS f, CAST((n_nationkey + 20) % 25 AS BIGINT) AS p, CAST(n_nationkey % 4 + 1 AS DOUBLE) AS len FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"""


def objects(spark, sf) -> DataFrame:
    """Line items as objects of an order's frame; equal rows are told apart by their place among them."""
    from pyspark.sql import Window

    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("now"), micros("o_orderdate").alias("t"))
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    li = read(spark, sf, "lineitem").withColumn("pos", F.row_number().over(w))
    track = F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 50)
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "now", "t", F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"), "pos", (F.col("l_quantity") - 25).alias("x"), (F.col("l_extendedprice") / 1e4 - 3).alias("y"), track.alias("track"), (F.lit(1.0) - F.col("l_tax") * 8).alias("existence"), F.col("l_returnflag").alias("kind")
    )


OBJECTS = """ob AS (SELECT o_custkey AS now, epoch_us(o_orderdate) AS t, l_orderkey AS frame, l_linenumber AS line,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
  l_quantity - 25 AS x, l_extendedprice / 1e4 - 3 AS y, CASE WHEN l_linenumber <> 7 THEN l_partkey % 50 END AS track, 1.0 - l_tax * 8 AS existence, l_returnflag AS kind
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
near AS (SELECT *, sqrt(x * x + y * y) AS distance FROM ob WHERE existence >= 0.5)"""
