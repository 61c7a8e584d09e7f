"""Vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.vector import distance_score
from tessera.operators import search
from tessera.operators.knn import block_knn
from tessera.sources.bind import frame, table

V = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
PAIRS = f"WITH {V}, s AS (SELECT a.id AS q, b.id AS id, a.label AS la, b.label AS lb, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.id <> b.id AND a.id % 50 = 0)"
RANK = "row_number() OVER (PARTITION BY q ORDER BY sim DESC, id)"


def probes(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "vectors").filter("id % 50 = 0")


@query(PAIRS + f", r AS (SELECT *, {RANK} AS rank FROM s) SELECT q, id, round(greatest(0, 1 - sqrt(greatest(0, 2 - 2 * sim)) / 2), 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def knn_entities(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest of every probe, with the distance score M03."""
    return block_knn(probes(spark, d), frame(spark, d, "vectors"), 10).select("q", "id", distance_score(F.col("sim")).alias("score"), "rank")


@query(PAIRS.replace(" AND a.id % 50 = 0", "") + f", r AS (SELECT *, {RANK} AS rank FROM s WHERE la = lb AND sim >= 0.3) SELECT q, id, sim, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50")
def knn_same_type(spark: SparkSession, d: str) -> DataFrame:
    """For every entity the similar ones of its type at 0.3 or more, fifty (the endpoint's limit) at most."""
    v = frame(spark, d, "vectors")
    return block_knn(v, v, 50, 0.3, same_type=True)


@query(f"WITH {V}, s AS (SELECT a.id AS q, b.id // 4 AS note, max(round(list_dot_product(a.e, b.e), 6)) AS sim FROM v a JOIN v b ON a.id <> b.id AND a.id % 50 = 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, note) AS rank FROM s) SELECT q, note, sim, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def knn_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Four vectors are the chunks of a note; a note's best chunk counts, five notes a probe."""
    chunks = frame(spark, d, "vectors").withColumn("note", F.expr("id div 4"))
    return block_knn(probes(spark, d), chunks, 5, unit="note").withColumnRenamed("id", "note")


NAMED = "vec_id AS id, CAST(label AS BIGINT) AS type, CASE vec_id % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' ' || p_type ELSE 'item ' || CAST(vec_id AS STRING) END AS name, embedding FROM embeddings LEFT JOIN part ON vec_id = p_partkey"


@query(f"""WITH {V}, n AS (SELECT {NAMED.replace(', embedding', '')}), c AS (SELECT type, lower(name) AS name, min(id) AS rep FROM n WHERE name <> '' GROUP BY 1, 2),
named AS (SELECT greatest(a.rep, b.rep) AS candidate, least(a.rep, b.rep) AS existing, 'name_substring' AS reason FROM c a JOIN c b ON a.type = b.type AND a.name <> b.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' ')
  UNION ALL SELECT n.id, c.rep, 'name_equal' FROM n JOIN c ON n.type = c.type AND lower(n.name) = c.name AND n.id <> c.rep),
near AS (SELECT a.id AS candidate, b.id AS existing, 'embedding' AS reason, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.label = b.label AND a.id > b.id WHERE a.id NOT IN (SELECT candidate FROM named))
SELECT * FROM (SELECT *, CAST(NULL AS DOUBLE) AS sim FROM named UNION ALL SELECT * FROM near WHERE sim >= 0.35) WHERE NOT (candidate % 2 = 0 AND candidate - existing <= 60)""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """V08 at 0.35 instead of 0.85, as the vectors here are far apart; proposed before: even keys with the 60 keys below them."""
    e = table(spark, d, "embeddings").join(table(spark, d, "part"), F.col("vec_id") == F.col("p_partkey"), "left").selectExpr(*[x.strip() for x in NAMED.split(" FROM ")[0].split(", ")])
    proposed = e.filter("id % 2 = 0").select(F.col("id").alias("candidate"), F.explode(F.expr("sequence(id - 60, id - 1)")).alias("existing"))
    return search.merge_proposals(e, proposed, 0.35)


@query(f"WITH {V}, p AS (SELECT * FROM v WHERE id % 25 = 0), s AS (SELECT a.id AS note, b.id AS project, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN p b ON a.id <> b.id AND a.id % 25 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY sim DESC, project) AS rn, lead(sim) OVER (PARTITION BY note ORDER BY sim DESC, project) AS second FROM s) SELECT note, project, sim FROM r WHERE rn = 1 AND sim >= 0.3 AND (second IS NULL OR round(sim - second, 6) >= 0.02)")
def attach_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A note goes to its nearest project at 0.30 or more, if the runner-up is 0.02 behind (the margin is ours)."""
    v = frame(spark, d, "vectors")
    near = block_knn(v.filter("id % 25 <> 0"), v.filter("id % 25 = 0"), 2)
    order = Window.partitionBy("q").orderBy("rank")
    second = near.withColumn("second", F.lead("sim").over(order)).filter("rank = 1 and sim >= 0.3")
    return second.filter(F.col("second").isNull() | (F.round(F.col("sim") - F.col("second"), 6) >= 0.02)).select(F.col("q").alias("note"), F.col("id").alias("project"), "sim")


@query(PAIRS + """
, hits AS (SELECT q, id, sim, CASE WHEN lb < 4 THEN 0 WHEN lb < 7 THEN 1 ELSE 2 END AS source FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY sim DESC, id) AS pos FROM hits),
m AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, source, pos) AS rank FROM r WHERE pos <= 8)
SELECT q, id, CAST(source AS INT) AS source, sim, CAST(rank AS INT) AS rank FROM m WHERE rank <= 12""")
def hybrid_search_merge(spark: SparkSession, d: str) -> DataFrame:
    """Eight hits of each of three sources, merged by score, then source, then place."""
    v = frame(spark, d, "vectors").withColumn("source", F.expr("CASE WHEN type < 4 THEN 0 WHEN type < 7 THEN 1 ELSE 2 END"))
    hits = block_knn(probes(spark, d), v, 8, part="source")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "source", F.col("pos"))
    return hits.withColumnRenamed("rank", "pos").withColumn("rank", F.row_number().over(order)).filter("rank <= 12").select("q", "id", "source", "sim", "rank")


DEAD = "(id % 17 = 16 OR id % 23 = 22 OR id % 29 = 28)"
SCORE = "round(greatest(0, 1 - sqrt(greatest(0, 2 - 2 * sim)) / 2), 4)"


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of entities with the states that close the search to them."""
    return frame(spark, d, "vectors").selectExpr("*", "CASE WHEN id % 17 = 16 THEN 'pending' ELSE 'active' END AS status", "id % 23 = 22 AS archived", "CASE WHEN id % 29 = 28 THEN id - 1 END AS merged_into_id")


@query(PAIRS + f", r AS (SELECT *, {RANK} AS rank FROM s WHERE NOT {DEAD} AND id % 7 <> 3 AND lb IN (1, 2, 3)) SELECT q, id, {SCORE} AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10 AND {SCORE} >= 0.35")
def knn_entities_gated(spark: SparkSession, d: str) -> DataFrame:
    """V01 with all gates: merged, inactive, archived, of other types or left out by the caller."""
    v = searchable(spark, d)
    return search.entity_hits(probes(spark, d), v, 10, min_score=0.35, types=(1, 2, 3), exclude=v.filter("id % 7 = 3").select("id"))


WORDS = {-1: "ation", -2: "err", 0: "the"}
SERVED = PAIRS + f""", hits AS (SELECT q, CASE WHEN lb < 4 THEN 0 WHEN lb < 7 THEN 1 ELSE 2 END AS source, CASE WHEN lb < 4 THEN id // 4 ELSE id END AS id, max(sim) AS sim FROM s
  WHERE NOT (lb BETWEEN 4 AND 6 AND {DEAD}) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY sim DESC, id) AS pos FROM hits)"""
TEXTS = "(SELECT 'note' AS kind, doc_id AS id, text AS content, doc_id AS created_at FROM documents UNION ALL SELECT 'inbox', event_id, event_type, event_id FROM events)"


def served(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = probes(spark, d).unionByName(spark.createDataFrame([(q, None, None) for q in WORDS if q < 0], probes(spark, d).schema))
    v = searchable(spark, d)
    chunks = v.filter("type < 4").withColumns({"source": F.lit(0), "owner": F.expr("id div 4")})
    others = search.open_entities(v.filter("type between 4 and 6")).withColumn("source", F.lit(1)).unionByName(v.filter("type > 6").withColumn("source", F.lit(2))).withColumn("owner", F.col("id"))
    notes = table(spark, d, "documents").select(F.lit("note").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("doc_id").alias("created_at"))
    inbox = table(spark, d, "events").select(F.lit("inbox").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("event_id").alias("created_at"))
    return search.search_memory(asked, chunks.unionByName(others), notes.unionByName(inbox), WORDS, 5)


@query(SERVED + f""", m AS (SELECT q, ['note', 'entity', 'resource'][source + 1] AS kind, id, {SCORE} AS score, row_number() OVER (PARTITION BY q ORDER BY {SCORE} DESC, source, pos) AS rank FROM r WHERE pos <= 5),
f AS (SELECT w.q, t.kind, t.id, CAST(NULL AS DOUBLE) AS score, row_number() OVER (PARTITION BY w.q ORDER BY t.created_at DESC, t.kind, t.id) AS rank FROM (VALUES (-1, 'ation'), (-2, 'err')) w(q, word) JOIN {TEXTS} t ON contains(lower(t.content), w.word))
SELECT CAST(q AS BIGINT) AS q, kind, id, score, CAST(rank AS INT) AS rank FROM (SELECT * FROM m UNION ALL SELECT * FROM f) WHERE rank <= 5""")
def search_served(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits of notes, entities and resources; queries without any (here: those without a vector) by text."""
    return served(spark, d)[0]


@query(SERVED + " SELECT DISTINCT id FROM r WHERE source = 0 AND pos <= 5")
def search_reactivates(spark: SparkSession, d: str) -> DataFrame:
    """V05's second result: the notes that the searches hit, to be reactivated (T02, factor 0.5)."""
    return served(spark, d)[1]


@query("""
SELECT kind, id, snippet FROM (
  SELECT 'note' AS kind, doc_id AS id, substring(text, 1, 80) AS snippet FROM documents WHERE contains(lower(text), 'ation')
  UNION ALL
  SELECT 'inbox', event_id, props FROM events WHERE contains(lower(props), 'ation') OR contains(lower(event_type), 'err'))
ORDER BY kind, id LIMIT 100""")
def text_fallback_union(spark: SparkSession, d: str) -> DataFrame:
    """Substring search over notes and captures without wildcards, the first hundred."""
    notes = table(spark, d, "documents").filter(F.lower("text").contains("ation")).select(F.lit("note").alias("kind"), F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("snippet"))
    inbox = table(spark, d, "events").filter(F.lower("props").contains("ation") | F.lower("event_type").contains("err")).select(F.lit("inbox").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("snippet"))
    return notes.unionByName(inbox).orderBy("kind", "id").limit(100)
