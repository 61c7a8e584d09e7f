"""The memory model's frames, bound to the driver's tables (S01, S02, S12; D14: ids stay frames, never Python sets).

A binding is a list of expressions that Spark SQL and other SQL engines read alike, so a check in SQL starts
from the same rows.  Derived flags (status, archived, merged) come from the keys, as the tables hold no such
states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_ENTITY = ("id", "type", "canonical_name", "memory_strength", "mention_count", "status", "archived", "merged_into_id")


def _entity(prefix: str, key: str, kind: str, name: str, strength: str) -> list[str]:
    return [
        f"'{prefix}:' || CAST({key} AS STRING) AS id",
        f"{kind} AS type",
        f"{name} AS canonical_name",
        f"{strength} AS memory_strength",
        f"CAST({key} % 7 AS BIGINT) AS mention_count",
        f"CASE WHEN {key} % 17 = 16 THEN 'pending' ELSE 'active' END AS status",
        f"({key} % 23 = 22) AS archived",
        f"CASE WHEN {key} % 29 = 28 THEN '{prefix}:' || CAST({key} - 1 AS STRING) END AS merged_into_id",
    ]


#: Frame -> parts of (table, expressions); the parts are united.
FRAMES: dict[str, list[tuple[str, list[str]]]] = {
    "entities": [
        ("customer", _entity("c", "c_custkey", "c_mktsegment", "c_name", "round(abs(c_acctbal) / 10000, 4)")),
        ("supplier", _entity("s", "s_suppkey", "'supplier'", "s_name", "round(abs(s_acctbal) / 10000, 4)")),
        ("nation", _entity("n", "n_nationkey", "'nation'", "n_name", "CAST(0.9 AS DOUBLE)")),
        ("region", _entity("r", "r_regionkey", "'region'", "r_name", "CAST(1 AS DOUBLE)")),
    ],
    "relations": [
        ("customer", ["'c:' || CAST(c_custkey AS STRING) AS src", "'located_in' AS predicate", "'n:' || CAST(c_nationkey AS STRING) AS dst", "round(abs(c_acctbal) / 10000, 2) AS confidence", "CASE WHEN c_custkey % 11 = 10 THEN 'pending' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'confirmed' END AS review_status"]),
        ("supplier", ["'s:' || CAST(s_suppkey AS STRING) AS src", "'located_in' AS predicate", "'n:' || CAST(s_nationkey AS STRING) AS dst", "round(abs(s_acctbal) / 10000, 2) AS confidence", "CASE WHEN s_suppkey % 11 = 10 THEN 'pending' ELSE 'confirmed' END AS review_status"]),
        ("nation", ["'n:' || CAST(n_nationkey AS STRING) AS src", "'part_of' AS predicate", "'r:' || CAST(n_regionkey AS STRING) AS dst", "CAST(1 AS DOUBLE) AS confidence", "'confirmed' AS review_status"]),
    ],
    "facts": [
        (
            "orders",
            [
                "o_orderkey AS id",
                "'c:' || CAST(o_custkey AS STRING) AS entity_id",
                "o_orderpriority AS predicate",
                "o_orderstatus AS value",
                "round(CASE WHEN o_totalprice > 500000 THEN 1.0 ELSE o_totalprice / 500000 END, 4) AS confidence",
                "CAST(o_orderkey % 5 + 1 AS INT) AS persistence_value",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'hedged' WHEN o_orderkey % 3 = 1 THEN 'implicit' ELSE 'stated' END AS evidence",
                "o_orderdate AS created_at",
                "(o_orderkey % 19 = 18) AS archived",
                "(o_orderkey % 13 = 12) AS obsoleted",
                "o_custkey % 97 AS capture_id",
            ],
        )
    ],
    "captures": [("events", ["event_id AS id", "ts AS created_at", "user_id AS device_id", "event_type AS source", "value", "props AS content", "(event_type <> 'error') AS processed"])],
    "notes": [("documents", ["doc_id AS id", "text AS content", "lang AS language", "source", "n_chars"])],
    "vectors": [("embeddings", ["vec_id AS id", "embedding", "CAST(label AS BIGINT) AS type"])],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).selectExpr(*exprs) for t, exprs in FRAMES[name]])


def sql(name: str) -> str:
    """The same frame as a subquery."""
    return "(" + " UNION ALL ".join(f"SELECT {', '.join(exprs)} FROM {t}" for t, exprs in FRAMES[name]) + ")"
