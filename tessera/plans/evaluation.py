"""Evaluation queries over the driver's labels and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import evaluation as ops
from tessera.sources.bind import table

CASES = """(SELECT d.doc_id AS id, d.lang, d.source, d.text, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
GAPS = f"""(SELECT id, lang, quality, list_filter([
 CASE WHEN quality IS NOT NULL AND (quality = 1) <> (n_chars >= 400) THEN 'note: presence' END,
 CASE WHEN toxic IS NOT NULL AND (toxic = 1) <> contains(lower(text), 'worthless') THEN 'owner: tone' END,
 CASE WHEN lang <> 'en' AND contains(lower(text), 'the') THEN 'language: mixed' END], lambda g: g IS NOT NULL) AS gaps FROM {CASES})"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with the axes they assert as a map: a label that is absent asserts nothing."""
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "id")
    entries = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("key"), F.lit(1).alias("value"))) for k, cond in (("quality", F.col("quality").isNotNull()), ("toxic", F.col("toxic").isNotNull()), ("language", F.col("lang") != "en"))]))
    return c.withColumn("asserted", F.map_from_entries(entries))


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "note: presence": ("quality", (F.col("quality") == 1) != (F.col("n_chars") >= 400)),
        "owner: tone": ("toxic", (F.col("toxic") == 1) != F.lower("text").contains("worthless")),
        "language: mixed": ("language", F.lower("text").contains("the")),
    }
    return cases(spark, d).withColumn("gaps", ops.gap_list(F.col("asserted"), rules))


@query(f"SELECT id, array_to_string(gaps, ';') AS gaps, len(gaps) = 0 AS conforming FROM {GAPS}")
def eval_gaps(spark: SparkSession, d: str) -> DataFrame:
    return with_gaps(spark, d).select("id", F.array_join("gaps", ";").alias("gaps"), (F.size("gaps") == 0).alias("conforming"))


@query(f"WITH g AS (SELECT id, unnest(gaps) AS gap FROM {GAPS}) SELECT CASE WHEN starts_with(gap, 'note') THEN 'memory' WHEN starts_with(gap, 'owner') THEN 'people' ELSE 'other' END AS boundary, count(*) AS n, count(DISTINCT id) AS cases FROM g GROUP BY 1")
def eval_gap_by_boundary(spark: SparkSession, d: str) -> DataFrame:
    """E03, A09."""
    g = with_gaps(spark, d).select("id", F.explode("gaps").alias("gap"))
    return g.groupBy(ops.boundary_of(F.col("gap"), {"note": "memory", "owner": "people"}).alias("boundary")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("cases"))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS x, o_orderpriority AS y FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS x, CASE WHEN o_orderkey % 14 = 0 THEN 'z' ELSE o_orderpriority END AS y FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT a.id AS ai, b.id AS bi, CASE WHEN a.x IS NOT DISTINCT FROM b.x THEN 0 ELSE 1 END + CASE WHEN a.y IS NOT DISTINCT FROM b.y THEN 0 ELSE 1 END AS n FROM a FULL JOIN b ON a.id = b.id)
SELECT coalesce(ai, bi) AS id, CASE WHEN ai IS NULL THEN 'new' WHEN bi IS NULL THEN 'removed' WHEN n > 0 THEN 'changed' ELSE 'same' END AS change, CAST(CASE WHEN ai IS NOT NULL AND bi IS NOT NULL THEN n ELSE 0 END AS INT) AS axes FROM j""")
def eval_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two baselines, one made from the other by dropping and changing some cases."""
    o = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS x", "o_orderpriority AS y")
    new = o.filter("id % 11 <> 0").selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE x END AS x", "CASE WHEN id % 14 = 0 THEN 'z' ELSE y END AS y")
    return ops.diff(o.filter("id % 10 <> 0"), new, "id", ["x", "y"])


@query(f"SELECT id, array_to_string(list_filter(gaps, lambda g: g <> 'note: presence'), ';') AS still, list_contains(gaps, 'note: presence') AS gone, (id % 3 = 0) AS appeared FROM {GAPS}")
def eval_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Gaps that went and came between two scorings."""
    new = F.concat(F.array_except("gaps", F.array(F.lit("note: presence"))), F.when(F.col("id") % 3 == 0, F.array(F.lit("kind: new"))).otherwise(F.array().cast("array<string>")))
    g = with_gaps(spark, d).withColumn("new", new)
    return g.select("id", F.array_join(F.array_intersect("gaps", "new"), ";").alias("still"), (F.size(F.array_except("gaps", "new")) > 0).alias("gone"), (F.size(F.array_except("new", "gaps")) > 0).alias("appeared"))


@query("WITH h AS (SELECT user_id AS id, event_type AS branch, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT id, CAST(sum(n) AS BIGINT) AS runs, CAST(max(n) AS BIGINT) AS top FROM h GROUP BY 1) SELECT id, runs, round(top / runs, 4) AS rate, CASE WHEN top = runs THEN 'stable' WHEN top * 2 > runs THEN 'mostly' ELSE 'unstable' END AS verdict FROM t")
def eval_stability(spark: SparkSession, d: str) -> DataFrame:
    """How often repeated runs of a case take the same branch."""
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), "event_type").agg(F.count("*").alias("n"))
    t = h.groupBy("id").agg(F.sum("n").alias("runs"), F.max("n").alias("top"))
    verdict = F.when(F.col("top") == F.col("runs"), "stable").when(F.col("top") * 2 > F.col("runs"), "mostly").otherwise("unstable")
    return t.select("id", "runs", F.round(F.col("top") / F.col("runs"), 4).alias("rate"), verdict.alias("verdict"))


@query(f"""
WITH g AS (SELECT lower(trim(text)) AS t, min(lang) AS s, bool_or(coalesce(toxic, 0) = 1) AS f FROM {CASES} GROUP BY 1),
r AS (SELECT t, row_number() OVER (PARTITION BY s ORDER BY sha256('s1' || t), t) <= floor(count(*) OVER (PARTITION BY s) * 0.2) AS v FROM g WHERE NOT f)
SELECT c.id, CASE WHEN r.v THEN 'valid' ELSE 'train' END AS part FROM {CASES} c LEFT JOIN r ON lower(trim(c.text)) = r.t""")
def eval_split(spark: SparkSession, d: str) -> DataFrame:
    forced = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return ops.leak_free_split(cases(spark, d), "text", "lang", forced, 0.2, "s1").select("id", "part")


@query("SELECT 'nation' AS \"table\", count(*) AS n, CAST(sum(CAST(('0x' || substring(sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}'), 1, 12)) AS BIGINT)) AS DECIMAL(38,0)) AS hash FROM nation")
def state_normalise_hash(spark: SparkSession, d: str) -> DataFrame:
    return ops.state_hash(table(spark, d, "nation"), "nation")


@query("SELECT n_nationkey AS k, n_name AS v, 'left' AS side FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, n_name || '!', 'right' FROM nation WHERE n_nationkey % 5 = 0")
def golden_compare(spark: SparkSession, d: str) -> DataFrame:
    """E16 between a state and one with some values changed."""
    a = table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS v")
    b = a.selectExpr("k", "CASE WHEN k % 5 = 0 THEN v || '!' ELSE v END AS v")
    return ops.differing_rows(a, b)


@query("SELECT doc_id AS id, CASE WHEN n_chars > 30000 THEN 'truncated' WHEN n_chars < 200 THEN 'floor' WHEN NOT contains(text, '.') THEN 'form' WHEN lang NOT IN ('en', 'fr', 'de', 'es') THEN 'enum' END AS reason FROM documents")
def blocking_gate(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that blocks a capture."""
    reason = F.when(F.col("n_chars") > 30000, "truncated").when(F.col("n_chars") < 200, "floor").when(~F.col("text").contains("."), "form").when(~F.col("lang").isin("en", "fr", "de", "es"), "enum")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), reason.alias("reason"))


@query("SELECT split_part(source, 'c', 2) AS slot, count(*) AS n, CAST(floor(avg(n_chars)) AS BIGINT) AS mean, count(*) FILTER (quality = 0) AS rejected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def rejection_tally(spark: SparkSession, d: str) -> DataFrame:
    """A14, E18."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy(F.split_part("source", F.lit("c"), F.lit(2)).alias("slot"))
    return j.agg(F.count("*").alias("n"), F.floor(F.avg("n_chars")).alias("mean"), F.count_if(F.col("quality") == 0).alias("rejected"))


@query("""SELECT conv_id AS id, '{"messages":[' || string_agg(CAST(json_object('role', role, 'content', text) AS VARCHAR), ',' ORDER BY turn) || ']}' AS line FROM conversations GROUP BY 1""")
def chat_export(spark: SparkSession, d: str) -> DataFrame:
    """One JSON line a thread with all its texts, keys in a fixed order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # a thread's turns
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return g.select("id", F.to_json(F.struct(messages.alias("messages")), {"ignoreNullFields": "false"}).alias("line"))
