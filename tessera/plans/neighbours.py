"""Nearest neighbours of all vectors, with blocks skipped by their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import query
from tessera.operators.pruned import pruned_knn
from tessera.plans.search import V
from tessera.sources.bind import frame

ALL = f"WITH {V}, s AS (SELECT a.id AS q, b.id AS id, a.label AS la, b.label AS lb, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.id <> b.id)"


@query(ALL + ", r AS (SELECT q, id, sim, CAST(row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS INT) AS rank FROM s WHERE sim >= 0.2) SELECT q, id, sim, rank FROM r WHERE rank <= 4")
def neighbours_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest of every vector at 0.2 or more."""
    v = frame(spark, d, "vectors")
    return pruned_knn(v, v, 4, 0.2).hits.select("q", "id", "sim", "rank")


@query(ALL + " SELECT q, id, sim FROM s WHERE la = lb AND sim >= 0.35 AND q < id")
def neighbours_within_type(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one type at 0.35 or more."""
    v = frame(spark, d, "vectors")
    return pruned_knn(v, v, None, 0.35, same_type=True).hits.filter("q < id").select("q", "id", "sim")
