"""Decay, recurrence, schedules, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import temporal as t
from tessera.functions.text import squeeze
from tessera.sources.bind import frame, sql, table

CAP = sql("captures")
NOW, NOW_SQL = "2024-01-31 00:00:00", "TIMESTAMP '2024-01-31 00:00:00'"
DAYS = f"greatest(0, (epoch_us({NOW_SQL}) - epoch_us(created_at)) / 86400000000.0)"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"SELECT id, round(exp(-({DAYS}) / 30.0), 6) AS strength FROM {CAP} c")
def decay_strength(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "captures").select("id", F.round(t.decay(now(), F.col("created_at")), 6).alias("strength"))


@query(f"SELECT id, round(exp(-(CASE WHEN source = 'click' THEN 0.5 ELSE 1 END) * ({DAYS}) / 30.0), 4) AS strength FROM {CAP} c")
def decay_reactivated(spark: SparkSession, d: str) -> DataFrame:
    """A search hit moves the anchor half the way to now, which halves the age."""
    c = frame(spark, d, "captures")
    age = t.days_between(now(), F.col("created_at")) * F.when(F.col("source") == "click", 0.5).otherwise(1.0)
    return c.select("id", F.round(F.exp(-F.greatest(F.lit(0.0), age) / 30.0), 4).alias("strength"))


@query("""
SELECT o_orderkey AS id, CASE WHEN x >= DATE '1997-03-01' THEN x ELSE CAST(CAST(o_orderdate AS DATE) + to_years(CAST(1998 - year(o_orderdate) AS INT)) AS DATE) END AS next
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) + to_years(CAST(1997 - year(o_orderdate) AS INT)) AS DATE) AS x FROM orders)""")
def upcoming_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.next_yearly(F.col("o_orderdate").cast("date"), F.lit("1997-03-01").cast("date")).alias("next"))


@query(f"SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS captures, count(*) FILTER (processed) AS processed, count(DISTINCT device_id) AS devices FROM {CAP} c GROUP BY 1")
def iso_week_counts(spark: SparkSession, d: str) -> DataFrame:
    """T05, A17."""
    c = frame(spark, d, "captures").groupBy(F.date_trunc("week", "created_at").cast("date").alias("week"))
    return c.agg(F.count("*").alias("captures"), F.count_if("processed").alias("processed"), F.countDistinct("device_id").alias("devices"))


@query(f"SELECT id, CAST(epoch(CASE WHEN hour(created_at) >= 20 THEN date_trunc('day', created_at) + INTERVAL 20 HOUR WHEN hour(created_at) >= 7 THEN date_trunc('day', created_at) + INTERVAL 7 HOUR ELSE date_trunc('day', created_at) - INTERVAL 4 HOUR END) AS BIGINT) AS slot FROM {CAP} c")
def schedule_slot(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "captures").select("id", F.unix_seconds(t.slot_before(F.col("created_at"), (7, 20))).alias("slot"))


@query("""SELECT o_orderkey AS id, CAST(day + CASE WHEN step > 3 THEN step - 7 ELSE step END AS DATE) AS moved FROM (
SELECT *, CAST(o_orderdate AS DATE) AS day, CAST((o_orderkey % 7 - (isodow(o_orderdate) - 1) + 7) % 7 AS INT) AS step FROM orders)""")
def nearest_weekday(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.nearest_weekday(F.col("o_orderdate").cast("date"), F.expr("o_orderkey % 7")).alias("moved"))


SNAP_TEXT = "'Rendez-vous le ' || day(o_orderdate) || CASE o_orderkey % 7 WHEN 0 THEN ' Août' WHEN 1 THEN ' march' WHEN 2 THEN ' FÉVRIER' ELSE ', a ' || o_orderpriority END"
SNAP_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'episode' WHEN 1 THEN 'event' WHEN 2 THEN 'task' ELSE 'fact' END"


@query(f"""SELECT id, CASE WHEN wrong AND NOT regexp_matches(translate(lower(txt), '{t.MONTH_ACCENTS[0]}', '{t.MONTH_ACCENTS[1]}'), '{"|".join(t.MONTHS)}') AND day(moved) = day(d0) THEN moved ELSE d0 END AS day FROM (
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d0, {SNAP_TEXT} AS txt,
CASE {SNAP_KIND} WHEN 'episode' THEN CAST(o_orderdate AS DATE) > DATE '1996-06-15' WHEN 'fact' THEN false ELSE CAST(o_orderdate AS DATE) <= DATE '1996-06-15' END AS wrong,
CAST(CAST(o_orderdate AS DATE) + CASE {SNAP_KIND} WHEN 'episode' THEN to_months(-1) ELSE to_months(1) END AS DATE) AS moved FROM orders)""")
def bare_day_snap(spark: SparkSession, d: str) -> DataFrame:
    day = t.month_snap(F.col("o_orderdate").cast("date"), F.lit("1996-06-15").cast("date"), F.expr(SNAP_KIND), F.expr(SNAP_TEXT))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"))


@query("SELECT CAST(x AS DATE) AS day, isodow(x) - 1 AS weekday FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-22', TIMESTAMP '2024-02-16', INTERVAL 1 DAY)) AS x)")
def weekday_table(spark: SparkSession, d: str) -> DataFrame:
    """Nine days back, sixteen on."""
    day = F.explode(F.sequence(F.date_sub(now().cast("date"), 9), F.date_add(now().cast("date"), 16))).alias("day")
    return spark.range(1).select(day).select("day", F.weekday("day").cast("long").alias("weekday"))


@query(f"SELECT device_id, count(*) AS n FROM {CAP} c WHERE created_at >= TIMESTAMP '2024-01-29 00:00:00' AND created_at < TIMESTAMP '2024-01-30 00:00:00' GROUP BY device_id")
def lookback_24h(spark: SparkSession, d: str) -> DataFrame:
    """T12, trap T1: instants are compared, not strings."""
    c = frame(spark, d, "captures").filter("created_at >= timestamp_ntz'2024-01-29 00:00:00' and created_at < timestamp_ntz'2024-01-30 00:00:00'")
    return c.groupBy("device_id").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT *, '[' || role || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations),
r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t),
s AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE back <= 80 AND n > 1)
SELECT conv_id, count(*) FILTER (used <= 2000) AS lines, CAST(coalesce(max(used) FILTER (used <= 2000), 0) AS BIGINT) AS chars, count(*) > count(*) FILTER (used <= 2000) AS truncated FROM s GROUP BY conv_id""")
def day_context_budget(spark: SparkSession, d: str) -> DataFrame:
    """F20, W08, W09, §8.5: the newest 80 lines, oldest first, up to a budget of characters; the first overflow ends it; lone lines have no context."""
    conv = Window.partitionBy("conv_id")
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] "), squeeze(F.col("text"))).alias("line"))
    lines = lines.withColumns({"n": F.count("*").over(conv), "back": F.row_number().over(conv.orderBy(F.desc("turn")))}).filter("back <= 80 and n > 1")
    used = lines.withColumn("used", F.sum(F.length("line")).over(conv.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") <= 2000
    return used.groupBy("conv_id").agg(F.count_if(fits).alias("lines"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0).cast("long")).alias("chars"), (F.count("*") > F.count_if(fits)).alias("truncated"))


@query(f"""
WITH q AS (SELECT device_id, count(*) FILTER (NOT processed) AS queued, count(*) AS n, max(created_at) AS last FROM {CAP} c GROUP BY device_id)
SELECT device_id, CASE WHEN queued = 0 THEN '' WHEN last < TIMESTAMP '2024-01-29 00:00:00' THEN 'stale' WHEN n % 5 = 0 THEN 'instant' WHEN queued >= 14 THEN 'valve' ELSE 'scheduled' END AS reason FROM q""")
def trigger_policy(spark: SparkSession, d: str) -> DataFrame:
    """why a pass would run for a device's queue."""
    q = frame(spark, d, "captures").groupBy("device_id").agg(F.count_if(~F.col("processed")).alias("queued"), F.count("*").alias("n"), F.max("created_at").alias("last"))
    reason = F.when(F.col("queued") == 0, "").when(F.expr("last < timestamp_ntz'2024-01-29 00:00:00'"), "stale").when(F.col("n") % 5 == 0, "instant").when(F.col("queued") >= 14, "valve").otherwise("scheduled")
    return q.select("device_id", reason.alias("reason"))


@query(f"""
WITH e AS (SELECT o_orderkey AS id, 'event' AS kind, CASE WHEN x >= DATE '1997-03-01' THEN x ELSE CAST(x + INTERVAL 1 YEAR AS DATE) END AS day, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS title
  FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) + to_years(CAST(1997 - year(o_orderdate) AS INT)) AS DATE) AS x FROM orders)),
soon AS (SELECT * FROM e WHERE day < DATE '1997-03-08'),
b AS (SELECT c_custkey AS id, 'birthday' AS kind, CAST(DATE '1997-01-01' + INTERVAL 1 DAY * (c_custkey % 365) AS DATE) AS day, 'Birthday: ' || c_name AS title, c_name FROM customer)
SELECT id, kind, day, title FROM soon UNION ALL
SELECT id, kind, day, title FROM b WHERE day >= DATE '1997-03-01' AND day < DATE '1997-03-08' AND NOT EXISTS (SELECT 1 FROM soon WHERE soon.title = b.c_name)""")
def week_birthday_dedup(spark: SparkSession, d: str) -> DataFrame:
    """D01, §8.8: what is due within a week; a birthday goes if a due event already names its entity."""
    today, end = F.lit("1997-03-01").cast("date"), F.lit("1997-03-08").cast("date")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("event").alias("kind"), t.next_yearly(F.col("o_orderdate").cast("date"), today).alias("day"), name.alias("title"))
    soon = events.filter(F.col("day") < end)
    births = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("birthday").alias("kind"), F.date_add(F.lit("1997-01-01").cast("date"), F.expr("CAST(c_custkey % 365 AS INT)")).alias("day"), "c_name")
    births = births.filter((F.col("day") >= today) & (F.col("day") < end)).join(soon.select(F.col("title").alias("c_name")), "c_name", "left_anti")
    return soon.unionByName(births.select("id", "kind", "day", F.concat(F.lit("Birthday: "), "c_name").alias("title")))


@query(f"SELECT device_id, week, captures, errors, captures > 3 OR errors > 0 AS worth FROM (SELECT device_id, CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS captures, count(*) FILTER (source = 'error') AS errors FROM {CAP} c GROUP BY 1, 2)")
def digest_worth(spark: SparkSession, d: str) -> DataFrame:
    """One digest a device and week, written only if there is something to tell."""
    g = frame(spark, d, "captures").groupBy("device_id", F.date_trunc("week", "created_at").cast("date").alias("week"))
    g = g.agg(F.count("*").alias("captures"), F.count_if(F.col("source") == "error").alias("errors"))
    return g.withColumn("worth", (F.col("captures") > 3) | (F.col("errors") > 0))
