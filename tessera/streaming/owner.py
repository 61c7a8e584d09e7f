"""Who may run the cycle of a memory: R15."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(claims: DataFrame) -> DataFrame:
    """scope, owner, epoch, claimed_at from ``claims`` (scope, id, device, at): the latest claim wins (of equal times the larger id), and every claim is an epoch."""
    g = claims.groupBy("scope").agg(F.max(F.struct("at", "id", "device")).alias("last"), F.count("*").alias("epoch"))
    return g.select("scope", F.col("last.device").alias("owner"), "epoch", F.col("last.at").alias("claimed_at"))


def guarded(asked: DataFrame, claims: DataFrame) -> DataFrame:
    """``asked`` (scope, device) with owner, epoch and outcome: ``claimed`` where nobody owns the scope yet (the first device to ask, by name,
    does from now on, epoch 1), ``owner``, or ``not_cycle_owner``."""
    first = asked.groupBy("scope").agg(F.min("device").alias("first"))
    known = asked.join(owners(claims).select("scope", "owner", "epoch"), "scope", "left").join(first, "scope")
    owner = F.coalesce("owner", "first")
    outcome = F.when(F.col("owner").isNull() & (F.col("device") == F.col("first")), "claimed").when(F.col("device") == owner, "owner").otherwise("not_cycle_owner")
    return known.select("scope", "device", owner.alias("owner"), F.coalesce("epoch", F.lit(1).cast("long")).alias("epoch"), outcome.alias("outcome"))
