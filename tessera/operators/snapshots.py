"""What a snapshot of results lost against the one before, with severities: E10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How sure a fact is, by its evidence; unknown evidence is 0.
RANKS = {"explicit": 3, "hedged": 2, "implicit": 1}


def rank(evidence: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[evidence], F.lit(0))


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("none"))


def severities(before: DataFrame, after: DataFrame, facts_before: DataFrame, facts_after: DataFrame) -> DataFrame:
    """id, severity, issue for every case of ``before``; a case without an issue has no row.

    Cases: id, note (boolean), kind, input_type, event_date, relations, projects (numbers).  Facts: id, entity, predicate,
    evidence, position.  A note lost is a regression; another kind of a note kept, another input type, a lost event date, weaker
    evidence of a fact (compared with the last one of its entity and predicate before), and fewer facts, relations or
    projects are warnings; a case that is gone is ``absent`` and nothing else.
    """
    count = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    a = before.join(count(facts_before, "facts"), "id", "left").fillna(0, ["facts"]).alias("a")
    b = after.join(count(facts_after, "facts"), "id", "left").fillna(0, ["facts"]).withColumn("there", F.lit(True)).alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "left")
    one, two = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    issue = lambda severity, when, text: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), text.alias("issue")))
    changed = lambda c: F.concat(F.lit(f"{c} "), shown(one(c)), F.lit(" > "), shown(two(c)))
    kept = two("there").isNotNull()
    issues = [
        issue("absent", ~kept, F.lit("absent")),
        issue("regression", kept & one("note") & ~F.coalesce(two("note"), F.lit(False)), F.concat(F.lit("note lost: "), shown(one("kind")))),
        issue("warning", kept & one("note") & ~one("kind").eqNullSafe(two("kind")), changed("kind")),
        issue("warning", kept & ~one("input_type").eqNullSafe(two("input_type")), changed("input_type")),
        issue("warning", kept & one("event_date").isNotNull() & two("event_date").isNull(), F.concat(F.lit("event_date lost: "), shown(one("event_date")))),
        *[issue("warning", kept & (two(c) < one(c)), changed(c)) for c in ("facts", "relations", "projects")],
    ]
    told = both.select(F.col("a.id").alias("id"), F.explode(F.array_compact(F.array(*issues))).alias("i")).select("id", "i.severity", "i.issue")
    last = F.row_number().over(Window.partitionBy("id", "entity", "predicate").orderBy(F.desc("position")))
    was = facts_before.withColumn("r", last).filter("r = 1").select("id", "entity", "predicate", F.col("evidence").alias("was"))
    weaker = facts_after.join(was, ["id", "entity", "predicate"]).filter(rank(F.col("evidence")) < rank(F.col("was")))
    text = F.concat(F.lit("evidence "), "predicate", F.lit(" "), shown(F.col("was")), F.lit(" > "), shown(F.col("evidence")))
    return told.unionByName(weaker.select("id", F.lit("warning").alias("severity"), text.alias("issue")))
