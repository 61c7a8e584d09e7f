"""Smaller pieces of the surface: A08, A13, H06, J09, J16, P10, P11, R09, R16, R17, S02, U02, U04, W02, W11, W16."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.sources.bind import frame, sql, table

ENT, CAP, NOTES = sql("entities"), sql("captures"), sql("notes")


@query(f"SELECT type, count(*) AS n, min(id) AS first, max(id) AS last, round(avg(memory_strength), 6) AS mean FROM {ENT} e GROUP BY type")
def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A08."""
    g = frame(spark, d, "entities").groupBy("type")
    return g.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.round(F.avg("memory_strength"), 6).alias("mean"))


@query("SELECT max(n_chars) AS worst, CAST(floor(max(n_chars) / 4) AS BIGINT) AS tokens, max(n_chars) / 4 > 8192 AS over FROM documents")
def worst_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The largest text against a window of 8192 tokens of four characters."""
    worst = F.max("n_chars")
    return table(spark, d, "documents").agg(worst.alias("worst"), F.floor(worst / 4).alias("tokens"), (worst / 4 > 8192).alias("over"))


@query("SELECT vec_id AS id, round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 4) AS total, true AS same, CAST(4 * len(embedding) AS INT) AS bytes FROM embeddings")
def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors packed as little-endian 32-bit floats and read back, every component; a batch is one array cut into rows."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        flat, ends = np.concatenate([*v, []]).astype("<f4").tobytes(), 4 * v.str.len().cumsum()
        return pd.Series([flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        ends = (b.str.len() // 4).cumsum()
        return pd.Series(np.split(np.frombuffer(b"".join(b), "<f4"), ends[:-1]))

    packed = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", pack("embedding").alias("blob"))
    back = packed.withColumn("back", unpack("blob"))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("id", F.round(total, 4).alias("total"), (F.col("back") == F.col("embedding").cast("array<float>")).alias("same"), F.length("blob").alias("bytes"))


@query(f"WITH h AS (SELECT 'c:' || CAST(o_custkey AS VARCHAR) AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), t AS (SELECT * FROM h ORDER BY rank LIMIT 100) SELECT CAST(t.rank AS INT) AS rank, t.id, e.canonical_name AS name FROM t JOIN {ENT} e ON t.id = e.id")
def hits_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a hit list in the order of the hits."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    top = top.select(F.concat(F.lit("c:"), "o_custkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))  # a hundred rows
    names = frame(spark, d, "entities").select("id", F.col("canonical_name").alias("name"))
    return top.join(names, "id").orderBy("rank").select("rank", "id", "name")


@query(f"SELECT id, type FROM {ENT} e WHERE coalesce(memory_strength, 0) >= 0.5 AND coalesce(mention_count, 0) >= 2 AND id NOT LIKE 's:%'")
def node_filters(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds with null as zero, and the kind of node."""
    e = frame(spark, d, "entities")
    return e.filter((F.coalesce("memory_strength", F.lit(0.0)) >= 0.5) & (F.coalesce("mention_count", F.lit(0)) >= 2) & ~F.col("id").startswith("s:")).select("id", "type")


@query("SELECT p_partkey AS id, len(list_filter(string_split('steel|BRASS|tin', '|'), lambda w: contains(lower(p_type), lower(w)))) > 0 AS hit FROM part")
def alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Any of the alternatives between bars."""
    hit = F.exists(F.split(F.lit("steel|BRASS|tin"), r"\|"), lambda w: F.contains(F.lower("p_type"), F.lower(w)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), hit.alias("hit"))


@query(f"SELECT 'entity' AS kind, id, canonical_name AS label FROM {ENT} e UNION ALL SELECT 'note', 'n:' || CAST(id AS VARCHAR), substring(content, 1, 20) FROM {NOTES} n")
def node_union(spark: SparkSession, d: str) -> DataFrame:
    """Entities and notes as nodes of one graph."""
    e = frame(spark, d, "entities").select(F.lit("entity").alias("kind"), "id", F.col("canonical_name").alias("label"))
    n = frame(spark, d, "notes").select(F.lit("note").alias("kind"), F.concat(F.lit("n:"), "id").alias("id"), F.substring("content", 1, 20).alias("label"))
    return e.unionByName(n)


@query("WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1), r AS (SELECT event_type, row_number() OVER (ORDER BY first) - 1 AS number FROM f) SELECT e.event_id AS id, CAST(r.number AS INT) AS number FROM events e JOIN r ON e.event_type = r.event_type")
def first_appearance_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Labels numbered by their first appearance."""
    e = table(spark, d, "events").select("event_id", "event_type")
    first = e.groupBy("event_type").agg(F.min("event_id").alias("first"))
    numbers = first.select("event_type", (F.row_number().over(Window.orderBy("first")) - 1).alias("number"))  # a row a label
    return e.join(numbers, "event_type").select(F.col("event_id").alias("id"), "number")


@query("SELECT o_custkey AS id, string_agg(o_orderstatus, '' ORDER BY first) AS statuses FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in the order of their first appearance."""
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.min("o_orderkey").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderstatus"))), lambda x: x["o_orderstatus"])  # one row a status
    return first.groupBy("id").agg(F.array_join(listed, "").alias("statuses"))


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS DOUBLE) AS at FROM customer ORDER BY coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, c_custkey) DESC, c_custkey LIMIT 40")
def coalesced_sort(spark: SparkSession, d: str) -> DataFrame:
    """Sorted by a value or what stands in for it, the first forty."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("at"))
    return c.orderBy(F.desc(F.coalesce("at", "id")), "id").limit(40)


@query(f"SELECT device_id, max(created_at) AS last, max(created_at) < TIMESTAMP '2024-01-29 12:00:00' AS expired FROM {CAP} c GROUP BY device_id")
def offer_expiry(spark: SparkSession, d: str) -> DataFrame:
    """What has not been renewed for a day and a half at the clock given is expired."""
    c = frame(spark, d, "captures").groupBy("device_id").agg(F.max("created_at").alias("last"))
    return c.withColumn("expired", F.expr("last < timestamp_ntz'2024-01-29 12:00:00'"))


@query(f"SELECT p.id AS proposal, e.canonical_name AS current, upper(e.canonical_name) AS proposed, p.capture_id FROM (SELECT id, entity_id, capture_id FROM {sql('facts')} f WHERE obsoleted) p LEFT JOIN {ENT} e ON p.entity_id = e.id AND e.status = 'active'")
def rename_queue(spark: SparkSession, d: str) -> DataFrame:
    """Rename and negation proposals, with the entity where it is still active."""
    names = frame(spark, d, "entities").filter("status = 'active'").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("current"))
    p = frame(spark, d, "facts").filter("obsoleted").select(F.col("id").alias("proposal"), "entity_id", "capture_id")
    return p.join(names, "entity_id", "left").select("proposal", "current", F.upper("current").alias("proposed"), "capture_id")
