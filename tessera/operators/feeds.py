"""What a reader sees of captures, notes and links: D07, F20, W08, W09."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.filters import clamped

#: How far back, how many captures and how many characters the context of a day may have; its first and its last line.
HOURS, CAPTURES, CHARACTERS = 24, 80, 8000
HEADER, CUT = "[CONTEXT]", "… (context truncated)"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def day_context(captures: DataFrame, batch: DataFrame, now: datetime, header: str = HEADER) -> DataFrame:
    """scope, context: a transcript of recent captures, for each scope of the batch.

    ``captures``: scope, id, content, created_at, processed; ``batch``: scope, place, content, created_at.  Processed captures since HOURS
    before ``now``, the newest CAPTURES in order of time, then the batch in its own order; lines until the first that would
    pass CHARACTERS in all, in whose place the cut is told.  One line alone resolves nothing: context is null.
    """
    since = F.lit(now - timedelta(hours=HOURS)).cast(dict(captures.dtypes)["created_at"])
    newest = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("created_at"), F.desc("id")))
    asked = batch.select("scope").distinct()
    prior = captures.filter(F.col("processed") & (F.col("created_at") >= since)).join(asked, "scope", "left_semi")
    prior = prior.withColumn("newest", newest).filter(F.col("newest") <= CAPTURES)
    line = lambda phase: F.concat(F.lit("["), F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("")), F.lit(f" · {phase}] "), squeezed(F.col("content")))
    lines = prior.select("scope", F.lit(0).alias("part"), (-F.col("newest")).cast("long").alias("place"), line("consolidated").alias("line"))
    lines = lines.unionByName(batch.select("scope", F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), line("pending").alias("line")))
    order = Window.partitionBy("scope").orderBy("part", "place")
    used = F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = lines.withColumn("used", used)
    # only lines that fit are gathered: some thousand characters a scope
    fits = F.col("used") <= CHARACTERS
    out = told.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(~fits).alias("over"), F.array_sort(F.collect_list(F.when(fits, F.struct("part", "place", "line")))).alias("lines"))
    text = F.concat(F.array(F.lit(header)), F.transform("lines", lambda x: x["line"]), F.when(F.col("over") > 0, F.array(F.lit(CUT))).otherwise(F.array().cast("array<string>")))
    return asked.join(out, "scope").select("scope", F.when(F.col("n") > 1, F.array_join(text, "\n")).alias("context"))


def feed(captures: DataFrame, limit: int = 30) -> DataFrame:
    """The newest captures (1 to 100), with a status: ``queued`` where there is none, but ``processed`` where the row was."""
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("queued"))
    status = F.when((status == "queued") & F.col("processed_at").isNotNull(), "processed").otherwise(status)
    return captures.withColumn("status", status).orderBy(F.desc("created_at"), F.desc("id")).limit(clamped(limit, 100))


def recent(captures: DataFrame, limit: int = 10) -> DataFrame:
    """The newest raw captures (1 to 50)."""
    return captures.select("id", "content", "source", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(clamped(limit, 50))


def resources(rows: DataFrame, entities: DataFrame, limit: int = 200) -> DataFrame:
    """The newest links, each with its entity's name and type; a merged entity's are null."""
    live = entities.filter("merged_into_id is null").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"), F.col("type").alias("entity_type"))
    top = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return top.join(live, "entity_id", "left")
