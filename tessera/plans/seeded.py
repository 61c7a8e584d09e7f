"""A seeded memory over the parts: a brand is a theme, its parts are the members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.sources import seed
from tessera.sources.bind import table

SEED, TODAY = 64, "2026-06-01"
_TYPES = "['person', 'place', 'project', 'organization', 'concept', 'tool']"
_MEMBERS = f"(SELECT DISTINCT p_brand AS theme, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, {_TYPES}[p_size % 6 + 1] AS type FROM part)"


def members(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("person", "place", "project", "organization", "concept", "tool"))), (F.col("p_size") % 6).cast("int"))
    return table(spark, d, "part").select(F.col("p_brand").alias("theme"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), kind.alias("type"))


def _draw(purpose: str, *names: str) -> str:
    return "CAST('0x' || substr(md5('" + f"{SEED}|{purpose}|' || " + " || '|' || ".join(names) + "), 1, 8) AS BIGINT)"


def _picked(values: tuple, number: str) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][CAST({number} % {len(values)} AS BIGINT) + 1]"


def _id(theme: str, name: str) -> str:
    return f"'syn-' || substr(md5({theme} || '|' || {name}), 1, 12)"


def _of(purpose: str) -> str:
    return _draw(purpose, "theme", "name")


_PLACED = f"(SELECT *, count(*) OVER (PARTITION BY theme) AS size, row_number() OVER (PARTITION BY theme ORDER BY {_of('part')} % 64, {_of('order')}, name) - 1 AS place FROM {_MEMBERS})"


@query(f"""
SELECT {_id('theme', 'name')} AS id, theme, name AS canonical_name, type, 1 + {_of('mentions')} % 12 AS mention_count, 2 + {_of('persistence')} % 4 AS persistence_value, name || ' - ' || theme AS summary,
  strftime(DATE '{TODAY}' - CAST({_picked(seed.DAYS, _of('days'))} AS INT), '%Y-%m-%d') AS last_mentioned, round(exp(-{_picked(seed.DAYS, _of('days'))} / 30.0::DOUBLE), 4) AS memory_strength, 'active' AS status FROM {_MEMBERS}""")
def seeded_entities(spark: SparkSession, d: str) -> DataFrame:
    e = seed.entities(members(spark, d), F.lit(TODAY).cast("date"), SEED)
    return e.withColumn("last_mentioned", F.col("last_mentioned").cast("string"))


_FACTS = " ".join(f"WHEN '{k}' THEN ['{p}', '{v}']" for k, (p, v) in seed.FACTS.items())


@query(f"SELECT {_id('theme', 'name')} AS entity_id, (CASE type {_FACTS} ELSE ['category', 'idea'] END)[1] AS predicate, (CASE type {_FACTS} ELSE ['category', 'idea'] END)[2] AS value, round(0.6 + {_of('fact')} % 36 / 100, 2) AS confidence FROM {_MEMBERS}")
def seeded_facts(spark: SparkSession, d: str) -> DataFrame:
    return seed.facts(members(spark, d), SEED)


@query(f"""
WITH p AS (SELECT * FROM {_PLACED}),
s AS (SELECT *, 1 + {_of('first')} % greatest(1, size - 1) AS one, 1 + {_of('second')} % greatest(1, size - 2) AS two FROM p),
t AS (SELECT *, unnest(CASE WHEN size >= 3 THEN [one, CASE WHEN two >= one THEN two + 1 ELSE two END] WHEN size = 2 THEN [1] ELSE [] END) AS step FROM s),
o AS (SELECT t.theme, t.name, p.name AS other FROM t JOIN p ON p.theme = t.theme AND p.place = (t.place + t.step) % t.size),
pairs AS (SELECT a.theme AS a_theme, a.name AS a, b.theme AS b_theme, b.name AS b FROM p a JOIN p b ON a.place = 0 AND b.place = 1 AND CAST(substr(b.theme, 7) AS BIGINT) = CAST(substr(a.theme, 7) AS BIGINT) + 1)
SELECT {_id('theme', 'name')} AS src, {_picked(seed.WITHIN, _draw('predicate', 'theme', 'name', 'other'))} AS predicate, {_id('theme', 'other')} AS dst, round(0.55 + {_draw('weight', 'theme', 'name', 'other')} % 36 / 100, 2) AS confidence FROM o
UNION ALL SELECT {_id('a_theme', 'a')}, 'leads_to', {_id('b_theme', 'b')}, round(0.5 + {_draw('bridge', 'a', 'b')} % 31 / 100, 2) FROM pairs""")
def seeded_links(spark: SparkSession, d: str) -> DataFrame:
    """Two links a member within its theme, and a bridge from each theme to the next."""
    m = members(spark, d)
    ends = seed.placed(m, SEED).filter("place < 2").select("theme", "name", "place", F.substring("theme", 7, 9).cast("long").alias("k"))
    a = ends.filter("place = 0").select(F.col("theme").alias("a_theme"), F.col("name").alias("a"), (F.col("k") + 1).alias("k"))
    b = ends.filter("place = 1").select(F.col("theme").alias("b_theme"), F.col("name").alias("b"), "k")
    pairs = a.join(b, "k").drop("k").withColumn("predicate", F.lit("leads_to"))
    return seed.links(m, SEED).unionByName(seed.bridges(m, pairs, SEED))


_N = {p: _draw(p, "CAST(id AS VARCHAR)") for p in ("start", "count", "stride", "form", "ago")}


@query(f"""
WITH p AS (SELECT * FROM {_PLACED}), z AS (SELECT DISTINCT theme, size FROM p),
n AS (SELECT event_id AS id, z.theme, size FROM events JOIN z ON z.theme = 'Brand#' || CAST(event_id % 25 AS VARCHAR)),
w AS (SELECT id, theme, i AS at_, ({_N['start']} % size + i * (1 + {_N['stride']} % greatest(1, (size - 1) // 2))) % size AS place FROM n, LATERAL (SELECT unnest(range(0, least(1 + {_N['count']} % 3, size))) AS i)),
m AS (SELECT id, list(p.name ORDER BY at_) AS mentioned FROM w JOIN p ON p.theme = w.theme AND p.place = w.place GROUP BY id)
SELECT id, replace(replace({_picked(seed.NOTES, _N['form'])}, '{{a}}', mentioned[1]), '{{b}}', coalesce(mentioned[2], mentioned[1])) AS content, array_to_string(mentioned, ';') AS mentioned,
  strftime(DATE '{TODAY}' - CAST({_picked(seed.DAYS, _N['ago'])} AS INT), '%Y-%m-%d') AS last_reactivated_at, round(exp(-{_picked(seed.DAYS, _N['ago'])} / 30.0::DOUBLE), 4) AS memory_strength FROM m""")
def seeded_notes(spark: SparkSession, d: str) -> DataFrame:
    """A note for every event."""
    numbers = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("Brand#"), (F.col("event_id") % 25).cast("string")).alias("theme"))
    n = seed.notes(members(spark, d), numbers, F.lit(TODAY).cast("date"), SEED)
    return n.withColumns({"mentioned": F.array_join("mentioned", ";"), "last_reactivated_at": F.col("last_reactivated_at").cast("string")})
