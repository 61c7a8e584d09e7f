"""Review queues and decisions over proposals that the driver's tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import queues
from tessera.sources.bind import frame, sql, table

ENT, REL, FACTS, CAP = sql("entities"), sql("relations"), sql("facts"), sql("captures")
STATUS = "CASE WHEN c_custkey % 4 = 3 THEN 'accepted' WHEN c_custkey % 9 = 8 THEN 'rejected' ELSE 'pending' END AS status"
_PRIORITY = "CASE CAST({k} AS INT) WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '5-LOW' WHEN 3 THEN 'works_at' ELSE 'located_in' END"
PREDICATES = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'relation' ELSE 'fact' END AS kind, {_PRIORITY.format(k='c_custkey % 5')} AS candidate, {_PRIORITY.format(k='(c_custkey + c_nationkey) % 5')} AS existing, {STATUS} FROM customer"
RENAMES = f"SELECT c_custkey AS id, 'c:' || CAST(c_custkey + c_nationkey AS STRING) AS entity_id, c_name AS proposed_name, c_custkey * 3 AS capture_id, {STATUS} FROM customer"
CREATIONS = f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE c_name END AS canonical_name, lower(c_mktsegment) AS proposed_type, c_custkey * 5 AS capture_id, {STATUS},
  CASE WHEN c_custkey % 6 = 0 THEN 'broken' WHEN c_custkey % 6 = 1 THEN '[]' ELSE '{{"aliases":["' || c_mktsegment || '"],"facts":[{{"predicate":"nation","value":"' || CAST(c_nationkey AS STRING) || '"}}]}}' END AS entity_data FROM customer"""
TYPES = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE lower(c_mktsegment) END AS proposed_type, CASE WHEN c_custkey % 10 <> 0 THEN 'c:' || CAST(c_custkey - c_custkey % 2 AS STRING) END AS candidate_entity_id, c_custkey * 7 AS capture_id, {STATUS} FROM customer"
NEGATIONS = f"SELECT c_custkey AS id, 'c:' || CAST(c_custkey AS STRING) AS entity_id, '1-URGENT' AS predicate, CASE WHEN c_custkey % 2 = 0 THEN '[' || CAST(c_custkey * 2 AS STRING) || ',' || CAST(c_custkey * 2 + 1 AS STRING) || ',' || CAST(c_custkey * 2 AS STRING) || ']' ELSE 'null' END AS candidate_ids, c_custkey * 2 AS capture_id, {STATUS} FROM customer"
ATTACHMENTS = f"SELECT c_custkey AS id, 's:' || CAST(c_custkey % 150 AS STRING) AS project_id, c_name AS content, c_custkey * 11 AS capture_id, {STATUS} FROM customer"
#: A user's decisions in order: a part of the proposals twice, some that do not exist.
DECISIONS = "SELECT o_orderkey AS seq, o_custkey * 2 AS id, CASE WHEN o_orderstatus = 'O' THEN 'reject' ELSE 'accept' END AS action, CASE o_orderpriority WHEN '1-URGENT' THEN ' ' WHEN '5-LOW' THEN 'thing' END AS name FROM orders"


def rows(spark: SparkSession, d: str, text: str) -> DataFrame:
    name = "orders" if text == DECISIONS else "customer"
    quoted = text.replace("{", "{{").replace("}", "}}")  # the JSON in it is no place to fill
    return spark.sql(quoted.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, d, name)})


def frames(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(frame(spark, d, n) for n in ("entities", "facts", "relations", "captures"))


_USE = f"u AS (SELECT kind, predicate, count(*) AS n, count(DISTINCT o) AS e FROM (SELECT 'fact' AS kind, predicate, entity_id AS o FROM {FACTS} UNION ALL SELECT 'relation', predicate, src FROM {REL}) GROUP BY ALL)"
_SHORT = f"(SELECT id AS capture_id, substring(coalesce(content, ''), 1, 280) AS evidence_excerpt FROM {CAP})"


@query(f"""WITH p AS ({PREDICATES}), {_USE} SELECT p.*, coalesce(a.n, 0) AS candidate_usage, coalesce(a.e, 0) AS candidate_entities, coalesce(b.n, 0) AS existing_usage, coalesce(b.e, 0) AS existing_entities, existing = 'works_at' AS target_is_family_head
FROM p LEFT JOIN u a ON a.kind = p.kind AND a.predicate = candidate LEFT JOIN u b ON b.kind = p.kind AND b.predicate = existing WHERE status = 'pending'""")
def queue_predicates(spark: SparkSession, d: str) -> DataFrame:
    _, facts, relations, _ = frames(spark, d)
    return queues.predicate_queue(rows(spark, d, PREDICATES), facts, relations)


@query(f"""WITH p AS ({RENAMES}), f AS (SELECT entity_id, count(*) AS n FROM {FACTS} WHERE NOT obsoleted AND NOT archived GROUP BY 1),
r AS (SELECT x AS entity_id, count(*) AS n FROM (SELECT src AS x FROM {REL} UNION ALL SELECT dst FROM {REL} WHERE dst <> src) GROUP BY 1)
SELECT p.*, e.type AS entity_type, coalesce(f.n, 0) AS facts_count, coalesce(r.n, 0) AS relations_count, coalesce(evidence_excerpt, '') AS evidence_excerpt
FROM p LEFT JOIN {ENT} e ON e.id = p.entity_id LEFT JOIN f ON f.entity_id = p.entity_id LEFT JOIN r ON r.entity_id = p.entity_id LEFT JOIN {_SHORT} c ON c.capture_id = p.capture_id WHERE p.status = 'pending'""")
def queue_renames(spark: SparkSession, d: str) -> DataFrame:
    return queues.rename_queue(rows(spark, d, RENAMES), *frames(spark, d))


@query(f"""WITH p AS ({CREATIONS}) SELECT id, canonical_name, proposed_type, p.capture_id, status, CASE WHEN starts_with(entity_data, '{{') THEN entity_data ->> '$.aliases[0]' ELSE '' END AS aliases, CASE WHEN starts_with(entity_data, '{{') THEN entity_data ->> '$.facts[0].value' ELSE '' END AS facts,
  coalesce(evidence_excerpt, '') AS evidence_excerpt FROM p LEFT JOIN {_SHORT} c ON c.capture_id = p.capture_id WHERE status = 'pending'""")
def queue_creations(spark: SparkSession, d: str) -> DataFrame:
    q = queues.creation_queue(rows(spark, d, CREATIONS), frame(spark, d, "captures")).drop("summary")
    return q.withColumns({"aliases": F.array_join("aliases", ","), "facts": F.array_join("facts.value", ",")})


@query(f"SELECT p.*, e.canonical_name AS candidate_name, e.type AS candidate_type, e.status AS candidate_status, c.content AS evidence_content FROM ({TYPES}) p LEFT JOIN {ENT} e ON e.id = candidate_entity_id LEFT JOIN {CAP} c ON c.id = p.capture_id WHERE p.status = 'pending'")
def queue_types(spark: SparkSession, d: str) -> DataFrame:
    return queues.type_queue(rows(spark, d, TYPES), frame(spark, d, "entities"), frame(spark, d, "captures"))


@query(f"""WITH p AS ({NEGATIONS} WHERE c_custkey % 4 <> 3 AND c_custkey % 9 <> 8),
m AS (SELECT p.id, string_agg(CAST(f.id AS VARCHAR) || '=' || f.value, ',' ORDER BY f.id) AS candidates FROM p JOIN {FACTS} f ON p.id % 2 = 0 AND f.id IN (p.id * 2, p.id * 2 + 1) GROUP BY 1),
a AS (SELECT entity_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS entity_facts FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY predicate, id) AS r FROM {FACTS} WHERE NOT obsoleted AND NOT archived) WHERE r <= 50 GROUP BY 1)
SELECT p.id, p.entity_id, p.predicate, p.capture_id, p.status, e.canonical_name AS entity_name, coalesce(candidates, '') AS candidates, coalesce(entity_facts, '') AS entity_facts, coalesce(evidence_excerpt, '') AS evidence_excerpt
FROM p LEFT JOIN {ENT} e ON e.id = p.entity_id LEFT JOIN m ON m.id = p.id LEFT JOIN a ON a.entity_id = p.entity_id LEFT JOIN {_SHORT} c ON c.capture_id = p.capture_id""")
def queue_negations(spark: SparkSession, d: str) -> DataFrame:
    entities, facts, _, captures = frames(spark, d)
    q = queues.negation_queue(rows(spark, d, NEGATIONS), entities, facts, captures)
    shown = F.array_join(F.transform("candidates", lambda x: F.concat_ws("=", x["id"].cast("string"), x["value"])), ",")
    return q.withColumns({"candidates": F.coalesce(shown, F.lit("")), "entity_facts": F.coalesce(F.array_join(F.transform("entity_facts", lambda x: x["id"].cast("string")), ","), F.lit(""))})


@query(f"SELECT p.*, e.canonical_name AS project_name, c.content AS capture_content FROM ({ATTACHMENTS}) p LEFT JOIN {ENT} e ON e.id = project_id LEFT JOIN {CAP} c ON c.id = p.capture_id WHERE p.status = 'pending'")
def queue_attachments(spark: SparkSession, d: str) -> DataFrame:
    return queues.attach_queue(rows(spark, d, ATTACHMENTS), frame(spark, d, "entities"), frame(spark, d, "captures"))


def _told(proposals: str, usable: str, unusable: str, more: str = "") -> str:
    """CTEs d (decisions with what they meet) and t (with outcome)."""
    return f"""p AS ({proposals}), d AS (SELECT d.*, p.id IS NOT NULL AS known, p.* EXCLUDE (id){more} FROM ({DECISIONS}) d LEFT JOIN p ON p.id = d.id),
g AS (SELECT *, known AND status = 'pending' AND (action = 'reject' OR coalesce({usable}, FALSE)) AS fits FROM d), h AS (SELECT id, min(seq) AS first, arg_min(action, seq) AS did FROM g WHERE fits GROUP BY 1),
t AS (SELECT g.*, CASE WHEN NOT known THEN 'not_found' WHEN status <> 'pending' THEN 'already_' || status WHEN seq = first THEN action || 'ed' WHEN seq > first THEN 'already_' || did || 'ed' ELSE '{unusable}' END AS outcome FROM g LEFT JOIN h ON h.id = g.id)"""


_TYPE = "trim(coalesce(CASE WHEN trim(name) <> '' THEN name END, proposed_type, ''))"


@query(f"WITH {_told(TYPES, _TYPE + chr(60) + chr(62) + chr(39) * 2, 'invalid')} SELECT seq, id, action, outcome FROM t")
def decide_types(spark: SparkSession, d: str) -> DataFrame:
    """what became of each decision on a type."""
    return queues.types_decided(rows(spark, d, TYPES), frame(spark, d, "entities"), rows(spark, d, DECISIONS))[0].select("seq", "id", "action", "outcome")


@query(f"""WITH {_told(TYPES, _TYPE + chr(60) + chr(62) + chr(39) * 2, 'invalid')},
c AS (SELECT candidate_entity_id AS id, arg_max(outcome, seq) AS did, arg_max({_TYPE}, seq) FILTER (outcome = 'accepted') AS new_type FROM t WHERE outcome IN ('accepted', 'rejected') AND candidate_entity_id IS NOT NULL GROUP BY 1)
SELECT e.id, coalesce(new_type, e.type) AS type, CASE did WHEN 'accepted' THEN 'active' WHEN 'rejected' THEN 'archived' ELSE e.status END AS status FROM {ENT} e LEFT JOIN c ON c.id = e.id""")
def decide_types_entities(spark: SparkSession, d: str) -> DataFrame:
    """the entities after decisions on types."""
    return queues.types_decided(rows(spark, d, TYPES), frame(spark, d, "entities"), rows(spark, d, DECISIONS))[1].select("id", "type", "status")


@query(f"""WITH {_told(CREATIONS, "starts_with(entity_data, '{') AND trim(canonical_name) <> ''", 'invalid_payload')}
SELECT 'new:' || id AS entity_id, canonical_name, proposed_type AS type, entity_data ->> '$.facts[0].predicate' AS predicate, entity_data ->> '$.facts[0].value' AS value FROM t WHERE outcome = 'accepted'""")
def decide_creations(spark: SparkSession, d: str) -> DataFrame:
    """the entities that accepted proposals bring into being, with their facts."""
    _, born, facts = queues.creations_decided(rows(spark, d, CREATIONS), rows(spark, d, DECISIONS))
    return born.withColumnRenamed("id", "entity_id").join(facts, "entity_id", "left").select("entity_id", "canonical_name", "type", "predicate", "value")


@query(f"""WITH {_told(ATTACHMENTS, 'project_id IN (SELECT id FROM ' + ENT + ' x)', 'gone')} SELECT seq, id, outcome, CASE WHEN outcome = 'accepted' THEN project_id END AS project_id FROM t""")
def decide_attachments(spark: SparkSession, d: str) -> DataFrame:
    """what became of each decision on an attachment."""
    told, _ = queues.attachments_decided(rows(spark, d, ATTACHMENTS), frame(spark, d, "entities"), rows(spark, d, DECISIONS))
    return told.select("seq", "id", "outcome", F.when(F.col("outcome") == "accepted", F.col("p.project_id")).alias("project_id"))
