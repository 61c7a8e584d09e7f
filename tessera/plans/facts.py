"""Facts, gates, merges, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.text import ENDINGS, PREFIXES, SUFFIXES, predicate_signature
from tessera.functions.visibility import active_fact
from tessera.operators import facts as ops
from tessera.sources.bind import frame, sql, table

FACTS, ENT = sql("facts"), sql("entities")
CONF = """round(least(1.0, greatest(0.0, CASE WHEN evidence = 'hedged' THEN least(raw, 0.84) ELSE raw END)), 4)"""
RAW = f"""SELECT f.id, f.evidence, CAST((CASE evidence WHEN 'hedged' THEN 0.65 WHEN 'implicit' THEN 0.40 ELSE 0.92 END) AS DOUBLE)
  + CAST((CASE WHEN e.status = 'active' THEN 0.05 ELSE 0.0 END) AS DOUBLE) + least(e.mention_count * CAST(0.02 AS DOUBLE), CAST(0.05 AS DOUBLE))
  + CAST((CASE persistence_value WHEN 5 THEN 0.2 WHEN 4 THEN 0.15 WHEN 3 THEN 0.05 WHEN 1 THEN -0.1 ELSE 0.0 END) AS DOUBLE) AS raw
  FROM {FACTS} f JOIN {ENT} e ON f.entity_id = e.id"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    entities = frame(spark, d, "entities").select(F.col("id").alias("entity_id"), (F.col("status") == "active").alias("existing"), "mention_count")
    known = frame(spark, d, "facts").join(entities, "entity_id")
    return known.withColumn("score", ops.base_confidence(F.col("evidence"), F.col("persistence_value"), F.col("existing"), F.col("mention_count")))


@query(f"SELECT id, {CONF} AS score, CASE WHEN {CONF} > 0.85 THEN 'facts' WHEN {CONF} >= 0.5 THEN 'pending' ELSE 'review' END AS destination FROM ({RAW})")
def fact_confidence(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", "score", ops.destination(F.col("score")).alias("destination"))


@query(f"SELECT destination, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT {CONF} AS score, CASE WHEN {CONF} > 0.85 THEN 'facts' WHEN {CONF} >= 0.5 THEN 'pending' ELSE 'review' END AS destination FROM ({RAW})) GROUP BY destination")
def facts_by_gate(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("score", ops.destination(F.col("score")).alias("destination"))
    return s.groupBy("destination").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"SELECT entity_id, lower(trim(predicate)) AS predicate, lower(trim(value)) AS value, min(id) AS id, max(confidence) AS confidence, max(created_at) AS last_confirmed, count(*) AS n FROM {FACTS} f WHERE NOT archived AND NOT obsoleted GROUP BY 1, 2, 3")
def facts_reinforce(spark: SparkSession, d: str) -> DataFrame:
    return ops.reinforce(frame(spark, d, "facts").filter(active_fact()))


@query(f"WITH f AS (SELECT * FROM {FACTS} f) SELECT a.id, min_by(b.id, (b.created_at, b.id)) AS obsoleted_by FROM f a LEFT JOIN f b ON a.entity_id = b.entity_id AND a.predicate = b.predicate AND (b.created_at, b.id) > (a.created_at, a.id) AND b.confidence >= a.confidence GROUP BY a.id")
def facts_supersede(spark: SparkSession, d: str) -> DataFrame:
    return ops.supersede(frame(spark, d, "facts").withColumn("family", F.col("predicate")))


@query(f"SELECT f.id FROM {FACTS} f WHERE NOT EXISTS (SELECT 1 FROM {sql('relations')} r WHERE r.src = f.entity_id AND (ascii(f.value) + f.id) % 25 = CAST(substring(r.dst, 3) AS BIGINT))")
def relation_restates_fact_anti(spark: SparkSession, d: str) -> DataFrame:
    """facts that repeat a relation of their entity go (here: the value names the relation's target by number)."""
    rel = frame(spark, d, "relations").select(F.col("src").alias("entity_id"), F.expr("CAST(substring(dst, 3) AS BIGINT)").alias("target"))
    return frame(spark, d, "facts").withColumn("target", F.expr("(ascii(value) + id) % 25")).join(rel, ["entity_id", "target"], "left_anti").select("id")


GATE_SRC = f"SELECT entity_id, capture_id, count(*) AS n_facts, max(persistence_value) AS p, min(predicate) AS only_predicate FROM {FACTS} f GROUP BY 1, 2"


@query(f"""
SELECT entity_id, capture_id, CASE WHEN capture_id % 9 = 0 OR (coalesce(p, 3) >= CASE WHEN n_facts <= 1 THEN 4 ELSE 2 END AND NOT (n_facts = 1 AND only_predicate IN ('event_date', 'occurs_on'))) THEN 'created'
  WHEN capture_id % 2 = 0 THEN 'proposed' ELSE 'ignored' END AS outcome FROM ({GATE_SRC})""")
def entity_gate(spark: SparkSession, d: str) -> DataFrame:
    g = frame(spark, d, "facts").groupBy("entity_id", "capture_id").agg(F.count("*").alias("n"), F.max("persistence_value").alias("p"), F.min("predicate").alias("only"))
    named, memory = F.col("capture_id") % 9 == 0, F.col("capture_id") % 2 == 0
    return g.select("entity_id", "capture_id", ops.entity_gate(named, F.lit(False), F.col("n"), F.col("p"), F.col("only"), memory).alias("outcome"))


@query(f"SELECT src, dst, CASE WHEN confidence < 0.7 THEN 'pending' ELSE 'confirmed' END AS review_status FROM {sql('relations')} r")
def relation_gate(spark: SparkSession, d: str) -> DataFrame:
    """F06."""
    return frame(spark, d, "relations").select("src", "dst", F.when(F.col("confidence") < 0.7, "pending").otherwise("confirmed").alias("review_status"))


@query("SELECT c_custkey AS id, c_mktsegment AS type, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'active' ELSE 'pending' END AS status, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS proposal FROM customer")
def vocabulary_gate(spark: SparkSession, d: str) -> DataFrame:
    """entities of a type outside the vocabulary wait, with a proposal."""
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "type string").withColumn("known", F.lit(True))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type")).join(known, "type", "left")
    return e.select("id", "type", F.when(F.col("known"), "active").otherwise("pending").alias("status"), F.when(F.col("known").isNull(), F.col("type")).alias("proposal"))


@query(f"""
WITH f AS (SELECT * FROM {FACTS} f), p AS (SELECT * FROM f WHERE confidence >= 0.5 AND confidence <= 0.85), n AS (SELECT DISTINCT entity_id, predicate, value FROM f WHERE confidence > 0.85)
SELECT p.id, round(least(1.0, p.confidence + 0.1), 4) AS confidence, round(least(1.0, p.confidence + 0.1), 4) > 0.85 AS promoted
FROM p JOIN n ON p.entity_id = n.entity_id AND p.predicate = n.predicate AND p.value = n.value""")
def validate_pending(spark: SparkSession, d: str) -> DataFrame:
    """a pending fact that an asserted one repeats gains 0.1 and is promoted above 0.85 (key and gain are ours)."""
    f = frame(spark, d, "facts")
    new = f.filter("confidence > 0.85").select("entity_id", "predicate", "value").distinct()
    c = F.round(F.least(F.lit(1.0), F.col("confidence") + 0.1), 4)
    return f.filter("confidence >= 0.5 and confidence <= 0.85").join(new, ["entity_id", "predicate", "value"], "left_semi").select("id", c.alias("confidence"), (c > 0.85).alias("promoted"))


MERGES = f"(SELECT id AS absorbed, merged_into_id AS survivor FROM {ENT} e WHERE merged_into_id IS NOT NULL)"


@query(f"SELECT coalesce(a.survivor, r.src) AS src, coalesce(b.survivor, r.dst) AS dst, count(*) AS n FROM {sql('relations')} r LEFT JOIN {MERGES} a ON r.src = a.absorbed LEFT JOIN {MERGES} b ON r.dst = b.absorbed GROUP BY 1, 2")
def merge_reroute(spark: SparkSession, d: str) -> DataFrame:
    merges = frame(spark, d, "entities").filter("merged_into_id is not null").select(F.col("id").alias("absorbed"), F.col("merged_into_id").alias("survivor"))
    return ops.reroute(frame(spark, d, "relations").select("src", "dst"), merges, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


CUST = "'Customer#' || lpad(CAST({} AS VARCHAR), 9, '0')"
TWO = f"[{CUST.format('CASE WHEN o_custkey % 29 = 28 THEN o_custkey - 1 ELSE o_custkey END')}, {CUST.format('CASE WHEN o_custkey % 29 = 0 AND o_custkey > 0 THEN o_custkey - 2 ELSE o_custkey - 1 END')}]"


def merged(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All merges of the binding accepted at once: customers whose key leaves 28 by 29 are absorbed by the one before."""
    e = frame(spark, d, "entities").filter("id like 'c:%'").select("id", "canonical_name", F.array(F.lower("canonical_name")).alias("aliases"), F.lit(None).cast("string").alias("merged_into_id"))
    merges = frame(spark, d, "entities").filter("id like 'c:%' and merged_into_id is not null").select(F.col("id").alias("absorbed"), F.col("merged_into_id").alias("survivor"))
    name = "'Customer#' || lpad(CAST({} AS STRING), 9, '0')".format
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.expr(name("o_custkey")), F.expr(name("o_custkey - 1"))).alias("mentions"))
    return ops.accept_merges(e, frame(spark, d, "facts").select("id", "entity_id"), frame(spark, d, "relations").select("src", "dst"), notes, merges)


@query(f"SELECT f.id, coalesce(m.survivor, f.entity_id) AS entity_id FROM {FACTS} f LEFT JOIN {MERGES} m ON f.entity_id = m.absorbed")
def merge_accept_facts(spark: SparkSession, d: str) -> DataFrame:
    """facts of the absorbed are the survivor's."""
    return merged(spark, d)["facts"]


@query(f"""SELECT 'c:' || c.c_custkey AS id, lower(c.c_name) || CASE WHEN a.c_name IS NULL THEN '' ELSE '|' || a.c_name END AS aliases, CASE WHEN c.c_custkey % 29 = 28 THEN 'c:' || (c.c_custkey - 1) END AS merged_into_id
FROM customer c LEFT JOIN customer a ON a.c_custkey = c.c_custkey + 1 AND a.c_custkey % 29 = 28""")
def merge_accept_entities(spark: SparkSession, d: str) -> DataFrame:
    """the survivor takes the absorbed name as an alias, the absorbed is a tombstone."""
    return merged(spark, d)["entities"].select("id", F.array_join("aliases", "|").alias("aliases"), "merged_into_id")


@query(f"SELECT o_orderkey AS id, array_to_string(CASE WHEN t[1] = t[2] THEN [t[1]] ELSE t END, '|') AS mentions FROM (SELECT o_orderkey, {TWO} AS t FROM orders)")
def merge_accept_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes name the survivor where they named the absorbed, once."""
    return merged(spark, d)["notes"].select("id", F.array_join("mentions", "|").alias("mentions"))


@query(f"SELECT id, CASE predicate WHEN '1-URGENT' THEN '2-HIGH' ELSE predicate END AS predicate FROM {FACTS} f")
def predicate_rename(spark: SparkSession, d: str) -> DataFrame:
    """One predicate is renamed everywhere."""
    return frame(spark, d, "facts").select("id", F.when(F.col("predicate") == "1-URGENT", "2-HIGH").otherwise(F.col("predicate")).alias("predicate"))


@query(f"SELECT DISTINCT f.entity_id AS id FROM {FACTS} f WHERE predicate = '1-URGENT'")
def propagate_stale(spark: SparkSession, d: str) -> DataFrame:
    """Entities reached by a renamed predicate need a new summary."""
    touched = frame(spark, d, "facts").filter("predicate = '1-URGENT'").select(F.col("entity_id").alias("id"))
    return frame(spark, d, "entities").select("id").join(touched, "id", "left_semi")


@query("SELECT c_custkey AS id, array_to_string(list_filter([c_name, lower(c_name), c_mktsegment], lambda x: lower(x) <> lower(c_name)) || [c_name || ' (old)'], '|') AS aliases FROM customer")
def alias_update(spark: SparkSession, d: str) -> DataFrame:
    """The old name joins the aliases, the new one leaves them whatever its case."""
    aliases = F.filter(F.array("c_name", F.lower("c_name"), "c_mktsegment"), lambda x: F.lower(x) != F.lower("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array_distinct(F.array_append(aliases, F.concat("c_name", F.lit(" (old)")))), "|").alias("aliases"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'P' || CASE WHEN o_orderpriority = 'O' OR o_orderpriority = 'P' THEN '' ELSE '|' || o_orderpriority END ELSE o_orderstatus || CASE WHEN o_orderpriority = o_orderstatus THEN '' ELSE '|' || o_orderpriority END END AS names FROM orders")
def names_swap(spark: SparkSession, d: str) -> DataFrame:
    """An element is replaced and repeats go, the order stays."""
    swapped = F.transform(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"), lambda x: F.when(x == "O", "P").otherwise(x))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_distinct(swapped), "|").alias("names"))


@query(f"SELECT f.id, (f.obsoleted OR (f.capture_id = 5 AND f.entity_id = 'c:' || CAST(f.id % 1500 AS STRING))) AS obsoleted FROM {FACTS} f")
def negation_accept(spark: SparkSession, d: str) -> DataFrame:
    """an accepted negation obsoletes its fact only if the fact is the named entity's."""
    f = frame(spark, d, "facts")
    accepted = f.filter("capture_id = 5").select("id", F.expr("'c:' || CAST(id % 1500 AS STRING)").alias("of")).withColumn("hit", F.lit(True))
    out = f.join(accepted, "id", "left")
    return out.select("id", (F.col("obsoleted") | F.coalesce(F.col("hit") & (F.col("of") == F.col("entity_id")), F.lit(False))).alias("obsoleted"))


@query(f"SELECT predicate, count(*) AS n, count(DISTINCT entity_id) AS ents FROM {FACTS} f WHERE NOT archived AND NOT obsoleted GROUP BY predicate")
def predicate_usage(spark: SparkSession, d: str) -> DataFrame:
    """A02."""
    f = frame(spark, d, "facts").filter(active_fact())
    return f.groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("ents")).orderBy(F.desc("ents"), F.desc("n"), "predicate")


VOCAB = "WITH u AS (SELECT p_type AS predicate, count(DISTINCT p_brand) AS ents FROM part GROUP BY 1)"


@query(VOCAB + " SELECT count(*) AS total, count(*) FILTER (ents >= 2) AS carried, count(*) FILTER (ents = 1) AS singletons, CAST(floor(100 * count(*) FILTER (ents = 1) / count(*)) AS BIGINT) AS percent FROM u")
def vocabulary_health(spark: SparkSession, d: str) -> DataFrame:
    """A03."""
    u = table(spark, d, "part").groupBy("p_type").agg(F.countDistinct("p_brand").alias("ents"))
    return u.agg(F.count("*").alias("total"), F.count_if(F.col("ents") >= 2).alias("carried"), F.count_if(F.col("ents") == 1).alias("singletons"), F.floor(100 * F.count_if(F.col("ents") == 1) / F.count("*")).alias("percent"))


PREDICATE = "CASE p_partkey % 4 WHEN 0 THEN 'is_' WHEN 1 THEN 'were_' ELSE '' END || replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_of' WHEN 1 THEN '_for_the' ELSE 's' END"
BARE = "trim(lower(p))"
for _affix in (*(f"^{a}" for a in PREFIXES), *(f"{a}$" for a in SUFFIXES)):
    BARE = f"regexp_replace({BARE}, '{_affix}', '')"
SIG = rf"""array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({BARE}, '[_\s]+'), lambda t: CASE WHEN t IN ('the', 'a', 'an') THEN '' WHEN length(t) > 4 THEN regexp_replace(t, '({'|'.join(ENDINGS)})$', '') ELSE t END), lambda t: t <> '')), ' ')"""


@query(f"SELECT {SIG} AS signature, count(*) AS n, min_by(p, (length(p), p)) AS canonical FROM (SELECT {PREDICATE} AS p FROM part) GROUP BY 1")
def predicate_signature_groups(spark: SparkSession, d: str) -> DataFrame:
    """Predicates that differ in affixes and word order, and the one to keep (the shortest)."""
    p = table(spark, d, "part").select(F.expr(PREDICATE).alias("p")).select(predicate_signature(F.col("p")).alias("signature"), "p")
    return p.groupBy("signature").agg(F.count("*").alias("n"), F.min(F.struct(F.length("p"), "p"))["p"].alias("canonical"))


ONE = "WITH p AS (SELECT DISTINCT replace(lower(p_type || '_' || p_name), ' ', '_') AS p FROM part), t AS (SELECT p, string_split(p, '_') AS t FROM p)"


@query(ONE + " SELECT a.p AS a, b.p AS b FROM t a JOIN t b ON a.p < b.p AND len(a.t) = len(b.t) AND len(a.t) >= 3 WHERE len(list_filter(range(1, len(a.t) + 1), lambda i: a.t[i] <> b.t[i])) = 1")
def predicate_one_token_diff(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.regexp_replace(F.lower(F.concat_ws("_", "p_type", "p_name")), " ", "_").alias("predicate")).distinct()
    return ops.one_token_pairs(p)


@query(f"""
WITH p AS (SELECT predicate, count(*) FILTER (value NOT IN ('O', 'F')) AS telling, count(*) AS n FROM {FACTS} f GROUP BY predicate)
SELECT predicate, n, CASE WHEN telling = 0 THEN 'safe' ELSE 'judge' END AS verdict FROM p""")
def granularity(spark: SparkSession, d: str) -> DataFrame:
    """a predicate can be widened safely if all its values are fillers."""
    telling = F.count_if(~F.col("value").isin("O", "F"))
    return frame(spark, d, "facts").groupBy("predicate").agg(F.count("*").alias("n"), F.when(telling == 0, "safe").otherwise("judge").alias("verdict"))


@query(f"""
WITH named AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'alias-' || CAST(o_custkey AS VARCHAR) END AS name FROM orders),
e AS (SELECT id, lower(canonical_name) AS key, 0 AS prio FROM {ENT} e UNION ALL SELECT 'c:' || CAST(c_custkey AS STRING), 'alias-' || CAST(c_custkey AS STRING), 1 FROM customer),
r AS (SELECT DISTINCT n.name, e.id, e.prio FROM named n JOIN e ON lower(n.name) = e.key),
s AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio, id) AS rn FROM r)
SELECT name, id FROM s WHERE rn = 1""")
def find_entity(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN 'customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') ELSE 'alias-' || CAST(o_custkey AS STRING) END AS name").distinct()
    known = frame(spark, d, "entities").select("id", "canonical_name", F.when(F.col("id").startswith("c:"), F.array(F.concat(F.lit("alias-"), F.substring("id", 3, 20)))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return ops.first_match(known, wanted)


@query(f"WITH s AS (SELECT id FROM {ENT} e WHERE mention_count > 4), t AS (SELECT DISTINCT entity_id AS id FROM {FACTS} f WHERE capture_id = 3) SELECT x.id, count(f.id) AS n_facts, coalesce(round(max(f.confidence), 4), 0) AS best FROM (SELECT id FROM s UNION SELECT id FROM t) x LEFT JOIN {FACTS} f ON x.id = f.entity_id AND NOT f.archived AND NOT f.obsoleted GROUP BY x.id")
def summary_targets(spark: SparkSession, d: str) -> DataFrame:
    """touched or stale entities with their active facts: what a summary would be written from."""
    f = frame(spark, d, "facts")
    targets = frame(spark, d, "entities").filter("mention_count > 4").select("id").union(f.filter("capture_id = 3").select("entity_id")).distinct()
    per = f.filter(active_fact()).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"), F.round(F.max("confidence"), 4).alias("m"))
    return targets.join(per, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_facts"), F.coalesce("m", F.lit(0.0)).alias("best"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, id) AS rn FROM {FACTS} f WHERE NOT archived AND NOT obsoleted) SELECT entity_id, string_agg(CAST(id AS STRING), ',' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY entity_id")
def proposals_top5_facts(spark: SparkSession, d: str) -> DataFrame:
    """Five facts a side, decorrelated."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "id")
    top = frame(spark, d, "facts").filter(active_fact()).withColumn("rn", F.row_number().over(order)).filter("rn <= 5")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string"))
    return top.groupBy("entity_id").agg(F.array_join(listed, ",").alias("top"))
