"""Relational surface: joins, aggregates, ranking, set operations, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.visibility import active_fact, confirmed_relation, live_entity
from tessera.operators import state
from tessera.sources.bind import frame, sql, table

ENT, REL, FACTS, CAP = sql("entities"), sql("relations"), sql("facts"), sql("captures")
LIVE = "merged_into_id IS NULL AND status = 'active' AND NOT archived"


@query(f"SELECT r.src, r.predicate, e.canonical_name AS target FROM {REL} r JOIN {ENT} e ON r.dst = e.id WHERE coalesce(review_status, 'confirmed') <> 'pending'")
def entity_card_out(spark: SparkSession, d: str) -> DataFrame:
    """J01, D04."""
    names = frame(spark, d, "entities").select(F.col("id").alias("dst"), F.col("canonical_name").alias("target"))
    return frame(spark, d, "relations").filter(confirmed_relation()).join(names, "dst").select("src", "predicate", "target")


@query(f"SELECT r.dst, r.predicate, e.canonical_name AS source FROM {REL} r JOIN {ENT} e ON r.src = e.id WHERE coalesce(review_status, 'confirmed') <> 'pending'")
def entity_card_in(spark: SparkSession, d: str) -> DataFrame:
    """J02, D04."""
    names = frame(spark, d, "entities").select(F.col("id").alias("src"), F.col("canonical_name").alias("source"))
    return frame(spark, d, "relations").filter(confirmed_relation()).join(names, "src").select("dst", "predicate", "source")


@query(f"SELECT a.canonical_name AS source, r.predicate, b.canonical_name AS target, r.confidence FROM {REL} r JOIN {ENT} a ON r.src = a.id JOIN {ENT} b ON r.dst = b.id WHERE r.review_status = 'pending'")
def pending_relations(spark: SparkSession, d: str) -> DataFrame:
    """The review queue of relations with both ends named."""
    e = frame(spark, d, "entities").select("id", "canonical_name")
    r = frame(spark, d, "relations").filter("review_status = 'pending'")
    r = r.join(e.toDF("src", "source"), "src").join(e.toDF("dst", "target"), "dst")
    return r.select("source", "predicate", "target", "confidence")


@query(f"""
SELECT 'fact' AS kind, CAST(f.id AS VARCHAR) AS id, e.canonical_name AS name FROM {FACTS} f LEFT JOIN {ENT} e ON f.entity_id = e.id WHERE f.capture_id = 7
UNION ALL SELECT 'relation', r.src || '>' || r.dst, e.canonical_name FROM {REL} r LEFT JOIN {ENT} e ON r.dst = e.id WHERE CAST(substring(r.src, 3) AS BIGINT) % 97 = 7
UNION ALL SELECT 'entity', id, canonical_name FROM {ENT} e WHERE mention_count = 3 AND type = 'supplier'""")
def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    """Everything one capture left, tagged."""
    e = frame(spark, d, "entities")
    names = e.select("id", F.col("canonical_name").alias("name"))
    facts = frame(spark, d, "facts").filter("capture_id = 7").join(names.withColumnRenamed("id", "entity_id"), "entity_id", "left").select(F.lit("fact").alias("kind"), F.col("id").cast("string"), "name")
    rels = frame(spark, d, "relations").filter("CAST(substring(src, 3) AS BIGINT) % 97 = 7").join(names.withColumnRenamed("id", "dst"), "dst", "left")
    rels = rels.select(F.lit("relation").alias("kind"), F.concat("src", F.lit(">"), "dst").alias("id"), "name")
    return facts.unionByName(rels).unionByName(e.filter("mention_count = 3 and type = 'supplier'").select(F.lit("entity").alias("kind"), "id", F.col("canonical_name").alias("name")))


@query("""
WITH v AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS version, count(*) AS entries FROM orders GROUP BY 1)
SELECT c.c_custkey AS id, v.version, coalesce(v.entries, 0) AS entries FROM customer c LEFT JOIN v ON c.c_custkey = v.o_custkey""")
def projects_list(spark: SparkSession, d: str) -> DataFrame:
    """Every project with its latest version and its number of entries."""
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"), F.count("*").alias("entries"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(v, "id", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))


@query(f"SELECT p.page_id AS id, e.canonical_name AS owner FROM pages p LEFT JOIN {ENT} e ON e.id = 'c:' || CAST(p.page_id AS VARCHAR) AND e.merged_into_id IS NULL")
def resources_with_owner(spark: SparkSession, d: str) -> DataFrame:
    """A left join whose condition stays in ON."""
    owners = frame(spark, d, "entities").filter("merged_into_id is null").select(F.col("id").alias("__e"), F.col("canonical_name").alias("owner"))
    return table(spark, d, "pages").withColumn("__e", F.concat(F.lit("c:"), "page_id")).join(owners, "__e", "left").select(F.col("page_id").alias("id"), "owner")


@query(f"SELECT p.page_id AS id FROM pages p WHERE EXISTS (SELECT 1 FROM {REL} r WHERE (r.src = 's:' || CAST(p.page_id AS VARCHAR) AND r.dst = 'n:3') OR (r.dst = 'n:' || CAST(p.page_id AS VARCHAR) AND r.src = 's:3'))")
def resources_tied(spark: SparkSession, d: str) -> DataFrame:
    """A relation in either direction, as one semi-join on the union of both."""
    r = frame(spark, d, "relations")
    pages = table(spark, d, "pages").select("page_id", F.explode(F.array(F.concat(F.lit("s:"), "page_id"), F.concat(F.lit("n:"), "page_id"))).alias("e"))
    tied = r.filter("dst = 'n:3' and src like 's:%'").select("src").union(r.filter("src = 's:3' and dst like 'n:%'").select("dst")).toDF("e")
    return pages.join(tied, "e", "left_semi").select(F.col("page_id").alias("id")).distinct()


@query("SELECT c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def devices_without_token(spark: SparkSession, d: str) -> DataFrame:
    """J13."""
    tokens = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(tokens, "id", "left_anti")


@query("""WITH h AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'user') AS graph, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant') AS note FROM conversations GROUP BY 1)
SELECT *, graph IS NOT NULL AND note IS NOT NULL AS complete FROM h""")
def halves_regrouped(spark: SparkSession, d: str) -> DataFrame:
    """Two halves regrouped by id, each with all its turns in order; complete only if both are there."""
    turns = lambda r: F.array_sort(F.collect_list(F.when((F.col("role") == r) & F.col("text").isNotNull(), F.struct("turn", "text"))))
    half = lambda r: F.when(F.size(turns(r)) > 0, F.array_join(F.transform(turns(r), lambda x: x["text"]), "\n"))
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(half("user").alias("graph"), half("assistant").alias("note"))
    return g.withColumn("complete", F.col("graph").isNotNull() & F.col("note").isNotNull())


@query(f"SELECT count(*) AS captures, count(*) FILTER (NOT processed) AS queued, count(DISTINCT device_id) AS devices, coalesce(max(id), 0) AS seq, count(*) FILTER (source = 'error') AS failed FROM {CAP} c")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """One pass."""
    c = frame(spark, d, "captures")
    return c.agg(F.count("*").alias("captures"), F.count_if(~F.col("processed")).alias("queued"), F.countDistinct("device_id").alias("devices"), F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("seq"), F.count_if(F.col("source") == "error").alias("failed"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """A10: a report over several groupings in one pass."""
    c = table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))
    return c.select("lang", "source", "n", "chars", F.col("level").cast("long"))


@query("SELECT l_returnflag AS model, CAST(sum(l_quantity) AS BIGINT) AS tokens, round(sum(l_quantity * 3 + l_linenumber * 15) / 1000000, 6) AS usd FROM lineitem GROUP BY 1")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Token buckets times tariffs."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"))
    return g.agg(F.sum("l_quantity").cast("long").alias("tokens"), F.round(F.sum(F.col("l_quantity") * 3 + F.col("l_linenumber") * 15) / 1_000_000, 6).alias("usd"))


@query("SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rn = 1")
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    """The language most of a source's notes have; ties to the first in the alphabet (ours)."""
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"))
    return best.select("source", F.col("b.lang").alias("lang"), (-F.col("b.m")).alias("n"))


@query("SELECT source, id, row FROM (SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE (row - 1) % greatest(1, n // 5) = 0 AND (row - 1) // greatest(1, n // 5) < 5")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five evenly spaced rows a source."""
    w = Window.partitionBy("source")
    r = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.row_number().over(w.orderBy("doc_id")).cast("long").alias("row"), F.count("*").over(w).alias("n"))
    step = F.expr("greatest(1L, n div 5)")
    return r.withColumn("step", step).filter("(row - 1) % step = 0 and (row - 1) div step < 5").select("source", "id", "row")


@query("SELECT o_custkey AS id, o_orderkey AS first_pass FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1")
def first_pass(spark: SparkSession, d: str) -> DataFrame:
    """Per case the first run in order of priority that passes."""
    ok = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return ok.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.struct("o_orderpriority", "o_orderkey"))["o_orderkey"].alias("first_pass"))


@query("(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """U03."""
    of = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return of("O").intersect(of("F")).subtract(of("P"))


@query(f"SELECT n.id, n.language, substring(n.content, 1, 280) AS excerpt, substring(coalesce(nullif(trim(n.language), ''), n.content, ''), 1, 60) AS title FROM {sql('notes')} n WHERE n.language IN ('en', 'fr') AND contains(lower(n.content), 'the') ORDER BY n.id DESC LIMIT 50")
def notes_list(spark: SparkSession, d: str) -> DataFrame:
    """Filtered list, newest first, fifty at most."""
    n = frame(spark, d, "notes").filter(F.col("language").isin("en", "fr") & F.lower("content").contains("the"))
    title = F.substring(F.coalesce(F.nullif(F.trim("language"), F.lit("")), "content", F.lit("")), 1, 60)
    return n.orderBy(F.desc("id")).limit(50).select("id", "language", F.substring("content", 1, 280).alias("excerpt"), title.alias("title"))


@query(f"SELECT id, CASE WHEN processed THEN 'processed' WHEN source = 'error' THEN 'failed' ELSE 'queued' END AS status FROM {CAP} c")
def capture_status(spark: SparkSession, d: str) -> DataFrame:
    """P07."""
    status = F.when(F.col("processed"), "processed").when(F.col("source") == "error", "failed").otherwise("queued")
    return frame(spark, d, "captures").select("id", status.alias("status"))


@query(f"SELECT a.id, CASE WHEN a.merged_into_id IS NULL THEN a.id ELSE b.id END AS target, coalesce(b.merged_into_id IS NULL, true) AS final FROM {ENT} a LEFT JOIN {ENT} b ON a.merged_into_id = b.id")
def tombstone_redirect(spark: SparkSession, d: str) -> DataFrame:
    """One hop to the survivor, and whether it is the last."""
    e = frame(spark, d, "entities").select("id", "merged_into_id")
    b = e.select(F.col("id").alias("target"), F.col("merged_into_id").alias("next"))
    j = e.join(b, F.col("merged_into_id") == F.col("target"), "left")
    return j.select("id", F.when(F.col("merged_into_id").isNull(), F.col("id")).otherwise(F.col("target")).alias("target"), F.col("next").isNull().alias("final"))


@query("WITH b AS (SELECT event_id AS id, event_id % 2000 AS key FROM events), s AS (SELECT DISTINCT l_orderkey % 700 AS key FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM b) SELECT r.id, r.key, CASE WHEN s.key IS NOT NULL OR rn > 1 THEN 'duplicate' ELSE 'queued' END AS outcome FROM r LEFT JOIN s ON r.key = s.key")
def capture_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """K01."""
    known = table(spark, d, "lineitem").selectExpr("l_orderkey % 700 AS key")
    batch = table(spark, d, "events").selectExpr("event_id AS id", "event_id % 2000 AS key", "event_id AS seq")
    return state.insert_or_ignore(known, batch, "key").select("id", "key", "outcome")


@query("SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS at FROM events GROUP BY 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """K03, K05."""
    e = table(spark, d, "events").selectExpr("user_id AS key", "event_id AS id", "ts AS at")
    last = e.groupBy("key").agg(F.max_by(F.struct("id", "at"), F.struct("at", "id")).alias("r")).select("key", "r.*")
    return state.upsert_latest(last.filter("id % 2 = 0"), last.filter("id % 2 = 1"), "key", "at")


@query("SELECT user_id AS key, max(value) AS value FROM events GROUP BY 1")
def upsert_max(spark: SparkSession, d: str) -> DataFrame:
    """K04."""
    e = table(spark, d, "events").selectExpr("user_id AS key", "value", "event_id")
    return state.upsert_max(e.filter("event_id % 2 = 0").select("key", "value"), e.filter("event_id % 2 = 1").select("key", "value"), "key", "value")


@query(f"SELECT CASE WHEN source = 'error' AND id % 2 = 0 THEN true ELSE processed END AS processed, count(*) AS n, count(*) FILTER (source = 'error' AND id % 2 = 0) AS changed FROM {CAP} c GROUP BY 1")
def requeue(spark: SparkSession, d: str) -> DataFrame:
    """A guarded update and how many rows it touched."""
    cond = (F.col("source") == "error") & (F.col("id") % 2 == 0)
    new, _ = state.update_where(frame(spark, d, "captures").withColumn("hit", cond), F.col("hit"), "processed", F.lit(True))
    return new.groupBy("processed").agg(F.count("*").alias("n"), F.count_if("hit").alias("changed"))


@query(f"SELECT e.id, CASE WHEN p.id IS NOT NULL THEN p.status ELSE e.status END AS status FROM {ENT} e LEFT JOIN (SELECT id, 'archived' AS status FROM {ENT} x WHERE mention_count = 6) p ON e.id = p.id")
def lifecycle_patch(spark: SparkSession, d: str) -> DataFrame:
    """K06."""
    e = frame(spark, d, "entities").select("id", "status", "mention_count")
    changes = e.filter("mention_count = 6").select("id", F.lit("archived").alias("status"))
    return state.patch(e.select("id", "status"), changes, "id", "status")


@query(f"SELECT 'fact' AS kind, count(*) AS n FROM {FACTS} f WHERE capture_id <> 11 UNION ALL SELECT 'capture', count(*) FROM {CAP} c WHERE NOT (processed AND device_id <> 11)")
def reprocess_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What a capture left goes, the capture is queued again."""
    gone = frame(spark, d, "captures").filter("device_id = 11").select(F.col("device_id").alias("capture_id")).distinct()
    facts = frame(spark, d, "facts").join(gone, "capture_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("fact").alias("kind"), "n")
    again = frame(spark, d, "captures").withColumn("processed", F.when(F.col("device_id") == 11, False).otherwise(F.col("processed")))
    return facts.union(again.filter("not processed").agg(F.count("*").alias("n")).select(F.lit("capture"), "n"))


@query(f"SELECT e.id, e.canonical_name AS name, coalesce(f.n, 0) AS n_facts, f.best FROM {ENT} e LEFT JOIN (SELECT entity_id, count(*) AS n, max(confidence) AS best FROM {FACTS} f WHERE NOT archived AND NOT obsoleted GROUP BY 1) f ON e.id = f.entity_id WHERE {LIVE}")
def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    """Visible entities with their active facts counted."""
    f = frame(spark, d, "facts").filter(active_fact()).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    e = frame(spark, d, "entities").filter(live_entity()).join(f, "id", "left")
    return e.select("id", F.col("canonical_name").alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n_facts"), "best")


@query("SELECT o_orderpriority AS boundary, count(*) AS n, count(DISTINCT o_orderstatus) AS labels, count(DISTINCT o_orderstatus) = 1 AND count(*) > 1 AS one_sided FROM orders GROUP BY 1")
def one_sidedness(spark: SparkSession, d: str) -> DataFrame:
    """A18, A09."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("boundary")).agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("labels"))
    return g.withColumn("one_sided", (F.col("labels") == 1) & (F.col("n") > 1))
