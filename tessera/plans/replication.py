"""Replication queries: a change log made from orders, a change a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.sources.bind import table
from tessera.streaming import lww, owner

LOG = [
    "l_orderkey * 10 + l_linenumber AS seq",
    "'t' || CAST(l_suppkey % 2 AS STRING) AS tbl",
    "CAST(l_partkey % 500 AS STRING) AS pk",
    "CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN '-' ELSE 'c' || CAST(l_linenumber % 4 AS STRING) END AS col",
    "CAST(l_orderkey AS STRING) AS value",
    "lpad(CAST((l_orderkey * 37 + l_linenumber * 11) % 100003 AS STRING), 12, '0') AS hlc",
    "CAST(l_suppkey AS STRING) AS device",
]
SQL_LOG = f"(SELECT {', '.join(LOG)} FROM lineitem)".replace("STRING", "VARCHAR")


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*LOG)


@query(f"SELECT tbl, count(*) AS n, min(seq) AS first, max(seq) AS last FROM {SQL_LOG} WHERE seq > 30000 GROUP BY tbl")
def changes_since_floor(spark: SparkSession, d: str) -> DataFrame:
    g = lww.changes_since(log(spark, d), 20_000, 30_000).groupBy("tbl")
    return g.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query(f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY tbl, pk, col ORDER BY hlc DESC, device DESC, value DESC) AS rn FROM {SQL_LOG}),
last AS (SELECT * FROM m WHERE rn = 1), dead AS (SELECT tbl, pk, hlc FROM last WHERE col = '-')
SELECT l.tbl, l.pk, l.col, l.value FROM last l LEFT JOIN dead ON l.tbl = dead.tbl AND l.pk = dead.pk WHERE l.col <> '-' AND (dead.hlc IS NULL OR l.hlc > dead.hlc)""")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    return lww.merge(log(spark, d))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey <> min(o_orderkey) OVER w THEN min(o_orderkey) OVER w END AS twin_of FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus, o_orderpriority)")
def twin_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return lww.twins(rows, ["o_custkey", "o_orderstatus", "o_orderpriority"]).select("id", "twin_of")


@query("SELECT user_id AS device_id, max(event_id) AS cursor, CAST(max(ts) AS DATE) AS pulled, user_id = 7 AS self, arg_max(user_id, event_id) = user_id AS owner FROM events GROUP BY user_id")
def device_list(spark: SparkSession, d: str) -> DataFrame:
    """Cursors and flags a device, oneself first."""
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("device_id")).agg(F.max("event_id").alias("cursor"), F.max("ts").cast("date").alias("pulled"))
    flags = g.withColumns({"self": F.col("device_id") == 7, "owner": F.lit(True)})
    return flags.orderBy(F.desc("self"), "device_id")


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(DISTINCT url) AS urls, min(page_id) AS first FROM pages GROUP BY 1")
def peer_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Addresses once each, by host."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")
    return table(spark, d, "pages").groupBy(host).agg(F.countDistinct("url").alias("urls"), F.min("page_id").alias("first"))


@query("""
WITH c AS (SELECT o_custkey % 100 AS scope, o_orderkey AS id, o_custkey AS device, o_orderdate AS at_ FROM orders WHERE o_custkey % 100 < 90),
o AS (SELECT scope, arg_max(device, (at_, id)) AS owner, count(*) AS epoch FROM c GROUP BY 1),
a AS (SELECT c_custkey % 100 AS scope, c_custkey AS device FROM customer), f AS (SELECT scope, min(device) AS first FROM a GROUP BY 1)
SELECT a.scope, a.device, coalesce(owner, first) AS owner, coalesce(epoch, 1) AS epoch, CASE WHEN owner IS NULL AND device = first THEN 'claimed' WHEN device = coalesce(owner, first) THEN 'owner' ELSE 'not_cycle_owner' END AS outcome
FROM a JOIN f USING (scope) LEFT JOIN o USING (scope)""")
def cycle_owner_guard(spark: SparkSession, d: str) -> DataFrame:
    """An order is a device's claim to its memory; every device asks to run the cycle; some memories have no owner yet."""
    claims = table(spark, d, "orders").filter("o_custkey % 100 < 90").selectExpr("o_custkey % 100 AS scope", "o_orderkey AS id", "o_custkey AS device", "o_orderdate AS at")
    return owner.guarded(table(spark, d, "customer").selectExpr("c_custkey % 100 AS scope", "c_custkey AS device"), claims)
