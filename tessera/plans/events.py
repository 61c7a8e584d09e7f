"""Extensions over events: windows, sessions, as-of. The reference has no such operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators.asof import asof_join
from tessera.sources.bind import table


@query("SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "event_type", "n", "total")


@query("SELECT (epoch_us(ts) // 1000000 // 1800 - o) * 1800 AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS t(o) GROUP BY 1")
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "n")


@query("""
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start"), "n")


@query("SELECT e.event_id AS id, p.value AS price FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def ext_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    marks = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    rows = e.filter("event_type <> 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return asof_join(rows, marks, "user_id", "ts", "price").select("id", "price")


@query("SELECT user_id, event_type, n, CAST(rank AS INT) AS rank FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 3")
def ext_topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return n.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
