"""Mutations as functions from state to state (K01-K12): nothing is updated in place, a job writes a new snapshot (K13); K14 is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``batch`` with outcome ``queued`` or ``duplicate``; of repeats within the batch the first (by ``seq``) counts."""
    known = state.select(F.col(key).alias("__k")).distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    out = batch.join(known, batch[key] == known["__k"], "left").withColumn("rn", first)
    return out.withColumn("outcome", F.when(F.col("known") | (F.col("rn") > 1), "duplicate").otherwise("queued")).select(*batch.columns, "outcome")


def upsert_latest(state: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """Of each key the row with the latest ``at``; a tie goes to the batch."""
    rows = state.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    value = F.struct(*state.columns)
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, "__new")).alias("__row")).select("__row.*")


def upsert_max(state: DataFrame, batch: DataFrame, key: str, value: str) -> DataFrame:
    """A floor that only rises."""
    return state.unionByName(batch).groupBy(key).agg(F.max(value).alias(value))


def patch(state: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """A column replaced where a patch has the key, null included."""
    p = changes.select(key, F.col(column).alias("__v"), F.lit(True).alias("__hit"))
    return state.join(p, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__v")).otherwise(F.col(column))).drop("__v", "__hit")


def update_where(state: DataFrame, condition: Column, column: str, value: Column) -> tuple[DataFrame, Column]:
    """The new state, and an aggregate that counts the rows it changes."""
    hit = F.coalesce(condition, F.lit(False))
    return state.withColumn(column, F.when(hit, value).otherwise(F.col(column))), F.count_if(hit)


def append(stored: DataFrame, batch: DataFrame, **defaults: str) -> DataFrame:
    """A batch added as it comes; ``defaults`` fill columns that it lacks."""
    return stored.unionByName(batch.withColumns({k: F.lit(v) for k, v in defaults.items()}), allowMissingColumns=True)
