"""As-of join (extension): each left row gets the last right row of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right``: one shuffle by key and one sort, no pairs are formed."""
    rows = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    marks = right.select(key, at, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, last).filter("__side = 1").select(*left.columns, value)
