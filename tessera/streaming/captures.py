"""Capture intake as streams: K01 within a horizon, windows over events (extensions; the trigger and its valve are in ``trigger``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """JSON files landing in a folder, with a declared schema."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).json(path)


def idempotent(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Each event once, within a horizon; beyond it the snapshot's anti-join decides."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["event_id"])


def marked(events: DataFrame, late: str | None) -> DataFrame:
    """The stream with a watermark; None: it has one, as Spark allows only one a column."""
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    w = marked(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    w = marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
