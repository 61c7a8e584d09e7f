"""Feeds, links and the context of a day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import feeds
from tessera.sources.bind import frame, sql, table

NOW = datetime(2024, 1, 20, 12, 0)
_LINE = "'[' || strftime(ts, '%Y-%m-%d %H:%M') || ' · {0}] ' || trim(regexp_replace(event_type || '  ' || props, '\\s+', ' ', 'g'))"


@query(rf"""
WITH e AS (SELECT *, user_id % 12 AS scope FROM events),
b AS (SELECT scope, 1 AS part, event_id AS place, {_LINE.format('pending')} AS line FROM e WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-20 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00'),
p AS (SELECT scope, 0 AS part, -row_number() OVER (PARTITION BY scope ORDER BY ts DESC, event_id DESC) AS place, {_LINE.format('consolidated')} AS line FROM e WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-19 12:00:00' AND scope IN (SELECT scope FROM b)),
l AS (SELECT * FROM p WHERE place >= -80 UNION ALL SELECT * FROM b),
u AS (SELECT *, sum(length(line)) OVER (PARTITION BY scope ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS used FROM l)
SELECT scope, CASE WHEN count(*) > 1 THEN '[CONTEXT]' || coalesce(string_agg(CASE WHEN used <= 8000 THEN chr(10) || line END, '' ORDER BY part, place), '') || CASE WHEN max(used) > 8000 THEN chr(10) || '… (context truncated)' ELSE '' END END AS context FROM u GROUP BY scope""")
def day_transcript(spark: SparkSession, d: str) -> DataFrame:
    """the context that each scope's unprocessed events of a morning are read with."""
    e = table(spark, d, "events").select((F.col("user_id") % 12).alias("scope"), F.col("event_id").alias("id"), F.concat("event_type", F.lit("  "), "props").alias("content"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("processed"))
    morning = F.col("created_at").between(F.lit("2024-01-20 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    batch = e.filter(~F.col("processed") & morning).withColumnRenamed("id", "place")
    return feeds.day_context(e, batch, NOW)


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_type <> 'error' THEN 'processed' ELSE 'queued' END AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def capture_feed(spark: SparkSession, d: str) -> DataFrame:
    """The feed, at its largest; old rows have no status but a time at which they were processed."""
    status = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") % 5 == 2, "queued")
    c = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"), F.when(F.col("event_type") != "error", F.col("ts")).alias("processed_at"))
    return feeds.feed(c, 1000).select("id", "status")


@query("SELECT event_id AS id, props AS content, event_type AS source FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def capture_recent(spark: SparkSession, d: str) -> DataFrame:
    """The newest raw captures; a limit of 60 is cut to 50."""
    return feeds.recent(frame(spark, d, "captures"), 60).select("id", "content", "source")


@query(f"""SELECT r.page_id AS id, r.url, e.canonical_name AS entity_name, e.type AS entity_type FROM (SELECT *, 'c:' || CAST(page_id * 3 AS VARCHAR) AS entity_id FROM pages ORDER BY page_id DESC LIMIT 200) r LEFT JOIN {sql('entities')} e ON e.id = r.entity_id AND e.merged_into_id IS NULL""")
def resource_list(spark: SparkSession, d: str) -> DataFrame:
    """Links with the entities they belong to."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.col("page_id").alias("created_at"), F.concat(F.lit("c:"), (F.col("page_id") * 3).cast("string")).alias("entity_id"))
    return feeds.resources(rows, frame(spark, d, "entities")).select("id", "url", "entity_name", "entity_type")
