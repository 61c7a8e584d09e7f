"""Intermediate tables of the core in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read again, so a lost executor costs a reread. Only a local master may leave that setting unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    path = f"{base.rstrip('/')}/core-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for this table goes when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``order``, without a task that sees all rows: ranges are numbered apart, and what lies before each is added."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = kept(placed.withColumns({"__range": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(2**33 - 1) + 1}).drop("__id"))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")
