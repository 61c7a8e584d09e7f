"""Standing visibility rules as reusable conditions (§1.4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def live_entity() -> Column:
    return F.col("merged_into_id").isNull() & (F.col("status") == "active") & ~F.col("archived")


def active_fact() -> Column:
    return ~F.col("archived") & ~F.col("obsoleted")


def confirmed_relation() -> Column:
    """Trap T4: a null status counts as confirmed."""
    return F.coalesce(F.col("review_status"), F.lit("confirmed")) != "pending"
