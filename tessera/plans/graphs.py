"""Graph queries: degree, ego, pruning, salience, communities, semantic edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.visibility import confirmed_relation, live_entity
from tessera.operators import graph
from tessera.operators.knn import block_knn
from tessera.sources.bind import frame, sql, table

ENT, REL = sql("entities"), sql("relations")
LIVE = "merged_into_id IS NULL AND status = 'active' AND NOT archived"
CONFIRMED = "coalesce(review_status, 'confirmed') <> 'pending'"
SALIENT = f"""
WITH nodes AS (SELECT * FROM {ENT} e WHERE {LIVE}),
edges AS (SELECT r.* FROM {REL} r WHERE {CONFIRMED} AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
salient AS (SELECT n.id, n.type, coalesce(d.degree, 0) AS degree, round(coalesce(n.memory_strength, 0) * (coalesce(d.degree, 0) + 1), 6) AS salience
            FROM nodes n LEFT JOIN deg d ON n.id = d.id)
"""


def live_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = frame(spark, d, "entities").filter(live_entity())
    return nodes, graph.induced(frame(spark, d, "relations").filter(confirmed_relation()), nodes)


@query(SALIENT + "SELECT id, degree, salience FROM salient ORDER BY salience DESC, id LIMIT 50")
def graph_degree_topk(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = live_graph(spark, d)
    return graph.with_salience(nodes, edges).orderBy(F.desc("salience"), "id").limit(50).select("id", "degree", "salience")


@query(SALIENT + "SELECT id, degree FROM salient WHERE degree > 0")
def graph_prune_isolated(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = live_graph(spark, d)
    return nodes.select("id").join(graph.degrees(edges), "id")


@query(SALIENT + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY salience DESC, id) AS rn, count(*) OVER (PARTITION BY type) AS n FROM salient) SELECT id, type, salience, CAST(rn AS INT) AS rn FROM ranked WHERE rn <= greatest(1, ceil(n * 0.1))")
def graph_top_pct_per_type(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = live_graph(spark, d)
    return graph.top_share(graph.with_salience(nodes, edges), "type", 0.1).select("id", "type", "salience", "rn")


@query(f"SELECT src, predicate, dst, confidence FROM {REL} r WHERE {CONFIRMED} AND (src = 'n:3' OR dst = 'n:3')")
def graph_ego_nation(spark: SparkSession, d: str) -> DataFrame:
    edges = frame(spark, d, "relations").filter(confirmed_relation()).select("src", "predicate", "dst", "confidence")
    return graph.ego(frame(spark, d, "entities"), edges, "n:3")


@query("""
SELECT least(s, p) AS a, greatest(s, p) AS b, round(sum(w), 6) AS weight
FROM (SELECT 's:' || CAST(l_suppkey AS STRING) AS s, 'p:' || CAST(l_partkey AS STRING) AS p, CASE WHEN l_discount = 0 THEN 1.0 ELSE l_discount END AS w FROM lineitem)
GROUP BY 1, 2""")
def graph_parallel_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").selectExpr("'s:' || CAST(l_suppkey AS STRING) AS src", "'p:' || CAST(l_partkey AS STRING) AS dst", "l_discount AS confidence")
    return graph.pair_weights(edges)


@query(f"""
WITH size AS (SELECT type, count(*) AS n, min(id) AS first FROM {ENT} e GROUP BY type),
num AS (SELECT type, n, row_number() OVER (ORDER BY n DESC, first) - 1 AS number FROM size)
SELECT e.id, CAST(num.number AS BIGINT) AS number, num.n AS size FROM {ENT} e JOIN num ON e.type = num.type""")
def graph_canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical_numbers(frame(spark, d, "entities").select("id", "type"), "type", "id").select("id", "number", "size")


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Louvain within each region's suppliers and parts; the region is the scope (a user's graph)."""
    home = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("long").alias("scope"))
    lines = table(spark, d, "lineitem").join(home, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    edges = lines.select("scope", F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("b:"), "p_brand", F.lit("/"), "p_type").alias("dst"), F.col("l_quantity").alias("confidence"))
    nodes = edges.select("scope", F.col("src").alias("id")).union(edges.select("scope", "dst")).distinct()
    return graph.communities(nodes, edges)


SEMANTIC = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s WHERE sim >= 0.3)
"""


@query(SEMANTIC + "SELECT least(a, b) AS src, greatest(a, b) AS dst, round(0.45 * max(sim), 4) AS weight FROM r WHERE rn <= 4 GROUP BY 1, 2")
def graph_semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's four nearest at a cosine of 0.3 or more (the vectors here are far apart), as undirected springs."""
    v = frame(spark, d, "vectors")
    near = block_knn(v, v, 4, 0.3)
    return near.groupBy(F.least("q", "id").alias("src"), F.greatest("q", "id").alias("dst")).agg(F.round(0.45 * F.max("sim"), 4).alias("weight"))


@query()
def graph_cluster_hull(spark: SparkSession, d: str) -> DataFrame:
    """G10 on the vectors' first two components, a cluster a label."""
    points = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("community_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return graph.cluster_hulls(points)


MENTIONS = f"""
WITH notes AS (SELECT o_orderkey AS note, o_custkey, o_orderpriority FROM orders),
mentions AS (SELECT note, upper('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS name FROM notes)
SELECT m.note, min(e.id) AS entity, CAST(1 AS DOUBLE) AS confidence
FROM mentions m JOIN {ENT} e ON lower(m.name) = lower(e.canonical_name) GROUP BY m.note"""


@query(MENTIONS)
def graph_mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array of names per note, matched case-blind to entities; of equal names the smallest id (trap T10)."""
    notes = table(spark, d, "orders").selectExpr("o_orderkey AS note", "to_json(array(upper('Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0')))) AS entities_mentioned")
    named = notes.select("note", F.explode(F.from_json("entities_mentioned", "array<string>")).alias("name"))
    ids = frame(spark, d, "entities").groupBy(F.lower("canonical_name").alias("name")).agg(F.min("id").alias("entity"))
    return named.select("note", F.lower("name").alias("name")).distinct().join(ids, "name").select("note", "entity", F.lit(1.0).alias("confidence"))


@query(SALIENT + """
, top AS (SELECT id, type, salience FROM salient ORDER BY salience DESC, id LIMIT 200),
kept AS (SELECT * FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)),
again AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM kept UNION ALL SELECT dst FROM kept) GROUP BY id)
SELECT t.id, t.type, t.salience, coalesce(a.degree, 0) AS degree FROM top t LEFT JOIN again a ON t.id = a.id""")
def graph_projection(spark: SparkSession, d: str) -> DataFrame:
    """Visibility, degree, salience, the 200 most salient nodes, and the degree again on what is left."""
    nodes, edges = live_graph(spark, d)
    top = graph.with_salience(nodes, edges).orderBy(F.desc("salience"), "id").limit(200).select("id", "type", "salience")
    again = graph.degrees(graph.induced(edges, top))
    return top.join(again, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
