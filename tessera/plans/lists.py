"""Lists, pages and nested answers: E02, K02, K12, P02, P03, P05, P14, R05, S10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.filters import list_notes
from tessera.operators.evaluation import AXES, asserted_axes, durable_count, nested_facts
from tessera.operators.facts import rewrite_predicates
from tessera.operators.state import append
from tessera.plans import gap_report
from tessera.sources.bind import frame, sql, table
from tessera.sources.files import change_page

NOTE = """doc_id AS id, doc_id AS created_at, source AS title, text AS content, '["' || source || '","' || lang || '"]' AS entities_mentioned,
CASE doc_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'task' WHEN 2 THEN 'event' ELSE 'episode' END AS kind,
CASE WHEN doc_id % 11 = 10 THEN 'pending' ELSE 'confirmed' END AS review_status, (doc_id % 13 = 12) AS archived"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*[e.strip() for e in NOTE.replace("\n", " ").split(", ")])


@query(f"""SELECT id, kind, review_status FROM (SELECT {NOTE} FROM documents) n WHERE NOT archived AND (contains(lower(title), 'the') OR contains(lower(content), 'the'))
AND contains(entities_mentioned, '"en"') AND kind = 'note' AND review_status <> 'pending' ORDER BY id DESC LIMIT 200""")
def notes_by_options(spark: SparkSession, d: str) -> DataFrame:
    """Four options at once; a limit of 500 is cut to the 200 a list may have."""
    return list_notes(_notes(spark, d), q="THE", mention="en", kind="note", limit=500).select("id", "kind", "review_status")


@query(f"SELECT id, kind FROM (SELECT {NOTE} FROM documents) n WHERE NOT archived AND review_status = 'pending' ORDER BY id DESC LIMIT 1")
def notes_pending_newest(spark: SparkSession, d: str) -> DataFrame:
    """A review state alone; a limit of 0 is raised to 1."""
    return list_notes(_notes(spark, d), review_status="pending", limit=0).select("id", "kind")


@query(f"SELECT CAST(id AS VARCHAR) AS id, content, 'stored' AS status FROM {sql('captures')} c UNION ALL SELECT conv_id || '/' || turn, text, 'queued' FROM conversations WHERE role = 'user'")
def captures_appended(spark: SparkSession, d: str) -> DataFrame:
    """A batch is added to what is stored, as it comes; nothing is compared or merged."""
    stored = frame(spark, d, "captures").select(F.col("id").cast("string").alias("id"), "content", F.lit("stored").alias("status"))
    batch = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    return append(stored, batch, status="queued")


PLAN = [("1-URGENT", "priority", "urgent"), ("2-HIGH", "priority", "high"), ("5-LOW", "priority", "low")]


@query(f"""WITH plan(old, wide, filled) AS (VALUES {', '.join(map(str, PLAN))})
SELECT f.id, coalesce(p.wide, f.predicate) AS predicate, CASE WHEN p.old IS NULL THEN f.value ELSE p.filled END AS value, p.old IS NOT NULL AS stale FROM {sql('facts')} f LEFT JOIN plan p ON f.predicate = p.old""")
def granularity_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Narrow predicates become a wide one and the value that their name held; summaries of what they touch are stale."""
    plan = spark.createDataFrame(PLAN, "old string, wide string, filled string")
    return rewrite_predicates(frame(spark, d, "facts"), plan).select("id", "predicate", "value", "stale")


@query("""WITH p AS (SELECT event_id AS seq, event_type, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 200)
SELECT *, (SELECT max(seq) FROM p) AS next, (SELECT max(event_id) FROM events) > (SELECT max(seq) FROM p) AS has_more FROM p""")
def changes_after(spark: SparkSession, d: str) -> DataFrame:
    """A page of changes after a cursor, with the next cursor and whether there is more."""
    changes = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type", "user_id")
    return change_page(changes, since=100, limit=200)


_PARSED = f"(SELECT id, from_json(answer, '{gap_report.SCHEMA}') AS a FROM ({gap_report.CASES}))"


@query(f"SELECT id, entity, f.predicate AS predicate, f.value AS value FROM (SELECT id, e.canonical_name AS entity, unnest(e.facts) AS f FROM (SELECT id, unnest(a.entities) AS e FROM {_PARSED}))")
def answer_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts nested in the entities of an answer, a row each."""
    return nested_facts(gap_report.cases(spark, d).select("id", "answer"))


@query(f"SELECT id, CAST(coalesce(len(flatten(list_transform(a.entities, lambda e: e.facts))), 0) + coalesce(len(a.relations), 0) AS BIGINT) AS durable FROM {_PARSED}")
def answer_durable(spark: SparkSession, d: str) -> DataFrame:
    """Facts and relations an answer holds."""
    return gap_report.cases(spark, d).select("id", durable_count(F.col("answer")).alias("durable"))


@query(f"""WITH b(axis, boundary) AS (VALUES {', '.join(map(str, AXES))}), c AS ({gap_report.CASES})
SELECT c.id, b.axis, b.boundary FROM c JOIN b ON list_contains(json_keys(c.body), b.axis)""")
def axes_asserted(spark: SparkSession, d: str) -> DataFrame:
    """The axes that a case asserts, null or not, each with its boundary."""
    return asserted_axes(gap_report.cases(spark, d).select("id", "body"))
