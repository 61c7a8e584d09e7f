"""Operator 2: mixing sources to target weights by capped water-filling, then seeded repetitions.

Water-filling: every source asks for a share of the budget in proportion to its weight, no source may
give more than ``max_epochs`` times its words, and what a clamped source leaves is shared again by weight.
The level L at which the sum of min(cap, L * weight) meets the budget has a closed form: with the sources
ordered by cap / weight, L is the largest of (budget - caps before k) / (weights from k on).  So no loop is
needed, and the per-source table (one row a source) is all that is ever ordered in one task.

Sampling: target / size whole epochs, and the fractional epoch takes documents in the order of a seeded
hash until its words are used up; the document at the border gives only the words still missing
(``cut_border=True``) or is taken whole if half of it is due (``cut_border=False``).
Hot sources: the running sum is cut into hash buckets of some thousand documents, each a window of its own,
so a source that holds a third of the rows spreads over all tasks.

Edge cases: null text or text without words has size 0, adds no words, and is repeated in whole epochs only; null source is a source of its
own, ordered last; rows with a null id are placed by their checksum, rows with equal ids by id, size and checksum;
repeated rows are separate documents (which of two equal rows is taken is not distinguishable); an empty table gives no rows; extra columns are
carried by ``repeat_rows`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, null_safe, repeated, row_sum, table, whole_row, word_count

#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (3, 1, 2)
BUDGET_HALVES = 3  # the mix takes 3/2 of all words
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKET_ROWS = 4096


def seeded(seed: str, row: Column) -> Column:
    """The place of a document in its source's seeded order. ``row``: its checksum, the place of rows without an id."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), row))))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: skey, source_size, n_docs, weight, target. ``sized`` has source, skey, size."""
    per = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    left = BUDGET_HALVES * F.sum("source_size").over(whole) - 2 * F.coalesce(F.sum("cap").over(fill), F.lit(0))
    weights = 2 * (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    level = F.max(F.col("step")).over(whole)
    return (
        per.withColumn("step", left.cast("double") / weights.cast("double"))
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("skey", "source_size", "n_docs", "weight", "target")
    )


def plan_mix(docs: DataFrame, scratch: Scratch, seed: str = SEED, cut_border: bool = True) -> DataFrame:
    """Per document: doc_id, skey, size, source_size, target, epochs (whole repetitions), extra (words of the fractional one), taken, h and row (its place)."""
    sized = scratch.keep(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_sum(docs).alias("row"))
        .withColumn("skey", null_safe(F.col("source")))
        .withColumn("h", seeded(seed, F.col("row"))),
        "sized",
    )
    targets = scratch.keep(source_targets(sized).withColumn("n_buckets", F.least(F.lit(65536), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long")), "targets")
    spread = sized.join(targets, "skey").withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * F.col("n_buckets"), 16))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = offsets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    due = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long") - F.col("offset") - F.col("inner")
    due = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), due))
    if not cut_border:
        due = F.when(2 * due >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("extra", due)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
        .select("doc_id", "skey", "size", "source_size", "target", "epochs", "extra", "taken", "h", "row")
    )


def repeat_rows(docs: DataFrame, scratch: Scratch, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the plan takes it whole, all columns kept.

    Documents of the fractional epoch are a prefix of their source's seeded order, so a row a source (whole epochs,
    the last place of the prefix) says how often each text is taken, and texts are not shuffled.  Equal rows share a
    place; where it is the last, and some of them are due only, one of them stands for all, as often as they are due.
    """
    place = lambda h, size, row: F.struct(h.alias("h"), size.alias("size"), row.alias("row"))
    plan = plan_mix(docs, scratch, seed, cut_border=False).withColumn("at", place(F.col("h"), F.col("size"), F.col("row")))
    per = plan.groupBy("skey", "at").agg(F.max("epochs").alias("epochs"), F.count("*").alias("equal"), F.count_if(F.col("extra") > 0).alias("due"))
    last = F.max(F.when(F.col("due") > 0, F.struct("at", "equal", "due")))
    ends = per.groupBy(F.col("skey").alias("key")).agg(F.max("epochs").alias("epochs"), last.alias("last"))
    ends = scratch.keep(ends, "ends")
    keyed = docs.select("doc_id", whole_row(docs).alias("row"), null_safe(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), row_sum(docs).alias("sum"))
    out = keyed.join(ends, "key").withColumn("place", place(seeded(seed, F.col("sum")), F.col("size"), F.col("sum")))
    some = F.coalesce((F.col("place") == F.col("last.at")) & (F.col("last.due") < F.col("last.equal")), F.lit(False))
    extra = (F.col("size") > 0) & F.coalesce(F.col("place") <= F.col("last.at"), F.lit(False))
    most = out.filter(~some).withColumn("times", F.col("epochs") + extra.cast("long"))
    rest = out.filter(some).dropDuplicates(["key", "sum"]).withColumn("times", F.col("epochs") * F.col("last.equal") + F.col("last.due"))
    return repeated(most.unionByName(rest).select("row", "times"), "times", "copy").select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM per),
steps AS (
  SELECT *, CAST(3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER f, 0) AS DOUBLE)
            / CAST(2 * (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS DOUBLE) AS step
  FROM weighed
  WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(step) OVER () * weight) AS target FROM steps),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) - before)) AS BIGINT) AS taken
FROM placed
"""
