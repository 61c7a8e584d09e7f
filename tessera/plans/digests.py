"""The weekly digest and the blocking gate, over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import digest, gate, snapshots
from tessera.plans import gap_report
from tessera.sources.bind import table

TODAY = date(1998, 6, 17)
_ENTITIES = "SELECT c_custkey AS id, c_name AS canonical_name, lower(c_mktsegment) AS type, DATE '1998-05-01' + CAST(c_custkey % 60 AS INT) AS created_at, DATE '1998-05-20' + CAST(c_custkey % 45 AS INT) AS last_mentioned, CAST(c_custkey * 37 % 101 AS BIGINT) AS mention_count FROM customer"
_FACTS = "SELECT o_orderkey AS id, o_custkey AS entity_id, CASE WHEN o_orderkey % 4 = 0 THEN 'has_birthday' ELSE lower(o_orderpriority) END AS predicate, CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE o_orderstatus END AS value, o_orderkey % 13 = 12 AS obsoleted, CAST(o_orderdate AS DATE) AS created_at FROM orders"
_NOTES = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'Party of ' || c_name || '!' ELSE 'Parcel ' || CAST(l_partkey AS STRING) END AS title, CASE l_returnflag WHEN 'A' THEN 'event' WHEN 'N' THEN 'task' ELSE 'digest' END AS kind, CASE WHEN l_quantity > 8 THEN CAST(l_shipdate AS DATE) END AS event_date, l_discount > 0.05 AS recurring, CASE WHEN l_tax > 0.06 THEN 'other' END AS owner, l_linestatus = 'F' AS archived, CAST(l_shipdate AS DATE) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    add = lambda q: q.replace("DATE '1998-05-01' + CAST(c_custkey % 60 AS INT)", "date_add(DATE '1998-05-01', CAST(c_custkey % 60 AS INT))").replace("DATE '1998-05-20' + CAST(c_custkey % 45 AS INT)", "date_add(DATE '1998-05-20', CAST(c_custkey % 45 AS INT))")
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "events")}
    return {
        "entities": spark.sql(add(_ENTITIES).replace("FROM customer", "FROM {customer}"), customer=t["customer"]),
        "facts": spark.sql(_FACTS.replace("FROM orders", "FROM {orders}"), orders=t["orders"]),
        "notes": spark.sql(_NOTES.replace("FROM lineitem JOIN orders ON", "FROM {lineitem} JOIN {orders} ON").replace("JOIN customer ON", "JOIN {customer} ON"), **{n: t[n] for n in ("lineitem", "orders", "customer")}),
        "captures": t["orders"].select(F.col("o_orderdate").alias("created_at")),
        "validations": t["orders"].select(F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("confirmed")),
    }


_NEXT = "CASE WHEN {d} + INTERVAL (year(DATE '1998-06-17') - year({d})) YEAR >= DATE '1998-06-17' THEN CAST({d} + INTERVAL (year(DATE '1998-06-17') - year({d})) YEAR AS DATE) ELSE CAST({d} + INTERVAL (year(DATE '1998-06-17') - year({d}) + 1) YEAR AS DATE) END"
_PAST = "BETWEEN DATE '1998-06-10' AND DATE '1998-06-17'"


@query(f"""
WITH e AS ({_ENTITIES}), f AS ({_FACTS}), n AS ({_NOTES}),
due AS (SELECT CAST(id AS VARCHAR) AS id, title, CASE WHEN recurring THEN {_NEXT.format(d='event_date')} ELSE event_date END AS day, kind FROM n WHERE kind IN ('event', 'task') AND NOT archived AND owner IS NULL AND event_date IS NOT NULL),
soon AS (SELECT * FROM due WHERE day BETWEEN DATE '1998-06-17' AND DATE '1998-06-24'),
born AS (SELECT DISTINCT e.id, canonical_name, {_NEXT.format(d='CAST(value AS DATE)')} AS day FROM f JOIN e ON f.entity_id = e.id WHERE predicate = 'has_birthday' AND NOT obsoleted),
b AS (SELECT * FROM born WHERE day BETWEEN DATE '1998-06-17' AND DATE '1998-06-24' AND NOT EXISTS (SELECT 1 FROM soon WHERE contains(lower(soon.title), lower(canonical_name))))
SELECT 'new_entity' AS part, CAST(id AS VARCHAR) AS id, canonical_name AS title, CAST(NULL AS VARCHAR) AS day, type AS kind, CAST(NULL AS BIGINT) AS n FROM e WHERE created_at {_PAST}
UNION ALL SELECT 'new_fact', CAST(f.id AS VARCHAR), canonical_name || ' ' || predicate || ' ' || value, NULL, NULL, NULL FROM f JOIN e ON f.entity_id = e.id WHERE f.created_at {_PAST} AND NOT obsoleted
UNION ALL SELECT 'new_note', CAST(id AS VARCHAR), title, NULL, kind, NULL FROM n WHERE created_at {_PAST} AND kind <> 'digest'
UNION ALL SELECT 'trend', CAST(id AS VARCHAR), canonical_name, NULL, NULL, mention_count FROM (SELECT * FROM e WHERE last_mentioned {_PAST} ORDER BY mention_count DESC, id LIMIT 5)
UNION ALL SELECT 'upcoming', id, title, CAST(day AS VARCHAR), kind, NULL FROM soon
UNION ALL SELECT 'upcoming', CAST(id AS VARCHAR), 'Birthday: ' || canonical_name, CAST(day AS VARCHAR), 'birthday', NULL FROM b
UNION ALL SELECT 'open_task', CAST(id AS VARCHAR), title, CAST(event_date AS VARCHAR), NULL, NULL FROM n WHERE kind = 'task' AND NOT archived AND owner IS NULL
UNION ALL SELECT 'count', 'captures', NULL, NULL, NULL, count(*) FROM orders WHERE CAST(o_orderdate AS DATE) {_PAST}
UNION ALL SELECT 'count', 'new_entities', NULL, NULL, NULL, count(*) FROM e WHERE created_at {_PAST}
UNION ALL SELECT 'count', 'new_facts', NULL, NULL, NULL, count(*) FROM f WHERE created_at {_PAST} AND NOT obsoleted
UNION ALL SELECT 'count', 'validated_facts', NULL, NULL, NULL, count(*) FROM orders WHERE CAST(o_orderdate AS DATE) {_PAST} AND o_orderstatus = 'F'
UNION ALL SELECT 'count', 'new_notes', NULL, NULL, NULL, count(*) FROM n WHERE created_at {_PAST} AND kind <> 'digest'""")
def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    """What a week's digest tells: new entities, facts and notes, trends, what is due, open tasks, and counts."""
    f = frames(spark, d)
    return digest.gather(f["entities"], f["facts"], f["notes"], f["captures"], f["validations"], TODAY)


_DIAG = [
    "CASE WHEN o_orderkey % 50 = 0 THEN 'timeout' END AS note_error", "CAST(NULL AS STRING) AS graph_error",
    "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(floor(o_totalprice / 50) AS BIGINT) END AS note_prompt_tokens", "CAST(o_orderkey % 9000 AS BIGINT) AS graph_prompt_tokens",
    "CASE WHEN o_orderkey % 31 = 0 THEN 'max_tokens' ELSE 'end' END AS note_stop", "CASE WHEN o_orderkey % 37 = 0 THEN 'max_tokens' END AS graph_stop",
    "o_orderkey % 41 <> 0 AS note_parsed", "CASE WHEN o_orderkey % 43 <> 0 THEN TRUE END AS graph_parsed",
]
SIZES, WINDOW = {"note": 3570, "graph": 5139}, 8192


def _half(half: str) -> str:
    return f"""CASE WHEN {half}_error <> '' THEN '{half}: call failed: ' || {half}_error WHEN {half}_prompt_tokens >= {WINDOW} THEN '{half}: prompt longer than the window' WHEN {half}_prompt_tokens < {SIZES[half] // 8} THEN '{half}: prompt cut on its way'
    WHEN {half}_stop = 'max_tokens' THEN '{half}: output cut' WHEN NOT coalesce({half}_parsed, FALSE) THEN '{half}: no JSON' END"""


@query(gap_report.GAPS.replace("g AS (SELECT id, body,", "g0 AS (SELECT id, body, note,", 1).split("g0 AS")[0].rstrip().rstrip(",") + f"""
, d AS (SELECT n.*, {', '.join(_DIAG)} FROM n JOIN orders ON n.id = o_orderkey)
SELECT id, coalesce({_half('note')}, {_half('graph')}, CASE WHEN answer = '{{}}' THEN 'no answer' WHEN len(list_filter(mem, lambda m: m.kind NOT IN ('note', 'task', 'event', 'episode'))) > 0 THEN 'kind: ' || list_filter(mem, lambda m: m.kind NOT IN ('note', 'task', 'event', 'episode'))[1].kind
  WHEN json_exists(body, '$.drop_guard') AND len(mem) + len(projs) + durable = 0 THEN 'no durable trace' END) AS reason FROM d""")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that blocks each answer."""
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS id", *_DIAG)
    return gate.gated(gap_report.cases(spark, d).join(orders, "id"), "body", "answer", SIZES, WINDOW).select("id", "reason")


_SNAP = {
    "a": ("l_linenumber <= 5", "l_quantity > 10", "l_discount", "CASE WHEN l_tax > 0.04 THEN 'explicit' WHEN l_tax > 0.02 THEN 'hedged' ELSE 'implicit' END"),
    "b": ("l_linenumber >= 2 AND l_orderkey % 20 <> 7", "l_quantity > 14", "l_discount - 0.01", "CASE WHEN l_tax > 0.05 THEN 'explicit' WHEN l_tax > 0.02 THEN 'hedged' WHEN l_tax > 0.01 THEN 'implicit' END"),
}


def _cases_sql(s: str) -> str:
    which, note, discount, evidence = _SNAP[s]
    return f"""c{s} AS (SELECT l_orderkey AS id, max(CASE WHEN {note} THEN 1 ELSE 0 END) = 1 AS note, min(l_returnflag) AS kind, max(l_linestatus) AS input_type, min(CASE WHEN {note} THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END) AS event_date,
  CAST(sum(CASE WHEN {discount} > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS relations, CAST(sum(CASE WHEN {discount} > 0.07 THEN 1 ELSE 0 END) AS BIGINT) AS projects FROM lineitem WHERE {which} GROUP BY l_orderkey),
f{s} AS (SELECT l_orderkey AS id, l_suppkey % 3 AS entity, 'p' || CAST(l_partkey % 2 AS STRING) AS predicate, {evidence} AS evidence, l_linenumber * 1000000 + l_partkey AS position FROM lineitem WHERE {which} AND {note})"""


_R = "CASE {0} WHEN 'explicit' THEN 3 WHEN 'hedged' THEN 2 WHEN 'implicit' THEN 1 ELSE 0 END"
_CHANGED = "'{0} ' || coalesce(CAST(a.{0} AS VARCHAR), 'none') || ' > ' || coalesce(CAST(b.{0} AS VARCHAR), 'none')"


@query(f"""
WITH {_cases_sql('a')}, {_cases_sql('b')},
a AS (SELECT ca.*, coalesce(n, 0) AS facts FROM ca LEFT JOIN (SELECT id, count(*) AS n FROM fa GROUP BY 1) USING (id)), b AS (SELECT cb.*, coalesce(n, 0) AS facts FROM cb LEFT JOIN (SELECT id, count(*) AS n FROM fb GROUP BY 1) USING (id)),
w AS (SELECT *, row_number() OVER (PARTITION BY id, entity, predicate ORDER BY position DESC) AS r FROM fa)
SELECT id, 'absent' AS severity, 'absent' AS issue FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT a.id, 'regression', 'note lost: ' || a.kind FROM a JOIN b ON a.id = b.id WHERE a.note AND NOT b.note
UNION ALL SELECT a.id, 'warning', {_CHANGED.format('kind')} FROM a JOIN b ON a.id = b.id WHERE a.note AND a.kind IS DISTINCT FROM b.kind
UNION ALL SELECT a.id, 'warning', {_CHANGED.format('input_type')} FROM a JOIN b ON a.id = b.id WHERE a.input_type IS DISTINCT FROM b.input_type
UNION ALL SELECT a.id, 'warning', 'event_date lost: ' || a.event_date FROM a JOIN b ON a.id = b.id WHERE a.event_date IS NOT NULL AND b.event_date IS NULL
{' '.join(f"UNION ALL SELECT a.id, 'warning', {_CHANGED.format(c)} FROM a JOIN b ON a.id = b.id WHERE b.{c} < a.{c}" for c in ('facts', 'relations', 'projects'))}
UNION ALL SELECT fb.id, 'warning', 'evidence ' || fb.predicate || ' ' || coalesce(w.evidence, 'none') || ' > ' || coalesce(fb.evidence, 'none') FROM fb JOIN w ON fb.id = w.id AND fb.entity = w.entity AND fb.predicate = w.predicate AND w.r = 1 WHERE {_R.format('fb.evidence')} < {_R.format('w.evidence')}""")
def snapshot_severities(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of what orders hold, the second with other lines, thresholds and evidence."""
    lines = table(spark, d, "lineitem")
    frames = [spark.sql(f"WITH {_cases_sql(s)} SELECT * FROM {k}{s}".replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines) for k in ("c", "f") for s in ("a", "b")]
    return snapshots.severities(*frames)
