"""Helpers shared by the training-data operators: scratch tables, word splitting, key columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The characters that separate words, in every contract of this package.
BLANKS = "\t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master, where it is unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts lineage: a lost executor costs a reread."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # what was shuffled for this table goes when it is written, not when the driver collects its garbage
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_others(self, *names: str) -> None:
        """Deletes all tables but these; no later plan may read the others."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        self.names.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, split at space, tab, line feed, vertical tab, form feed, carriage return. Null text: no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def null_safe(c: Column) -> Column:
    """A key that is never null and keeps null apart from every value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def row_sum(df: DataFrame) -> Column:
    """A checksum of whole rows, to tell apart rows with equal or null ids. Null and an absent value differ; maps and variants count as JSON."""

    def value(c: str, kind: str) -> Column:
        return F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) if "map<" in kind or "variant" in kind else F.col(f"`{c}`")

    return F.xxhash64(*[x for c, t in df.dtypes for x in (value(c, t), F.col(f"`{c}`").isNull())])


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one value, so that names of ours cannot clash with the caller's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def repeated(df: DataFrame, times: str, number: str, at_once: int = 1000) -> DataFrame:
    """Each row ``times`` times, with a number from 0. What is to be repeated very often is dealt to other tasks on the way."""
    last = F.floor((F.col(times) - 1) / at_once).cast("long")
    few = df.filter(F.col(times).between(1, at_once)).withColumn("__block", F.lit(0).cast("long"))
    many = df.filter(F.col(times) > at_once).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = many.repartition(F.xxhash64(F.rand(7)))
    ends = F.least(F.col(times), (F.col("__block") + 1) * at_once) - 1
    return few.unionByName(many).withColumn(number, F.explode(F.sequence(F.col("__block") * at_once, ends))).drop("__block")


def arrow_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, to be handed to Python in batches small enough for very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
