"""Review queues, each with what is needed to decide, and decisions as functions from state to state: D08, F15, J08, J09, J17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.predicates import HEADS

EXCERPT, SHOWN_FACTS = 280, 50
_FACT = "array<struct<predicate: string, value: string>>"


def with_excerpt(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Adds evidence_excerpt: the start of the capture (id, content) that a proposal (capture_id) rests on, empty without one."""
    text = captures.select(F.col("id").alias("capture_id"), F.substring(F.coalesce("content", F.lit("")), 1, EXCERPT).alias("evidence_excerpt"))
    return rows.join(text, "capture_id", "left").withColumn("evidence_excerpt", F.coalesce("evidence_excerpt", F.lit("")))


def predicate_queue(proposals: DataFrame, facts: DataFrame, relations: DataFrame, status: str = "pending") -> DataFrame:
    """Adds how often, and on how many entities, both predicates of a proposal (kind fact or relation, candidate, existing) are in use, and whether
    the existing one heads a family that has one value at a time."""
    use = facts.select(F.lit("fact").alias("kind"), "predicate", F.col("entity_id").alias("on")).unionByName(relations.select(F.lit("relation").alias("kind"), "predicate", F.col("src").alias("on")))
    use = use.groupBy("kind", "predicate").agg(F.count("*").alias("n"), F.countDistinct("on").alias("entities"))
    out = proposals.filter(F.col("status") == status)
    for side in ("candidate", "existing"):
        counts = use.select("kind", F.col("predicate").alias(side), F.col("n").alias(f"{side}_usage"), F.col("entities").alias(f"{side}_entities"))
        out = out.join(counts, ["kind", side], "left").fillna(0, [f"{side}_usage", f"{side}_entities"])
    return out.withColumn("target_is_family_head", F.col("existing").isin(*HEADS))


def rename_queue(proposals: DataFrame, entities: DataFrame, facts: DataFrame, relations: DataFrame, captures: DataFrame, status: str = "pending") -> DataFrame:
    """Adds the entity's type, its weight (active facts; relations from or to it, one between itself once) and the excerpt."""
    active = facts.filter("not obsoleted and not archived").groupBy("entity_id").agg(F.count("*").alias("facts_count"))
    ends = relations.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("relations_count"))
    kind = entities.select(F.col("id").alias("entity_id"), F.col("type").alias("entity_type"))
    out = proposals.filter(F.col("status") == status).join(kind, "entity_id", "left").join(active, "entity_id", "left").join(ends, "entity_id", "left")
    return with_excerpt(out.fillna(0, ["facts_count", "relations_count"]), captures)


def creation_queue(proposals: DataFrame, captures: DataFrame, status: str = "pending") -> DataFrame:
    """Adds what the entity would hold, from ``entity_data`` (JSON; unreadable: nothing): aliases, facts, summary; and the excerpt."""
    data = F.from_json("entity_data", f"aliases array<string>, summary string, facts {_FACT}")
    out = proposals.filter(F.col("status") == status).withColumn("data", data)
    lists = {"aliases": F.coalesce("data.aliases", F.array().cast("array<string>")), "facts": F.coalesce("data.facts", F.array().cast(_FACT)), "summary": F.col("data.summary")}
    return with_excerpt(out.withColumns(lists).drop("data", "entity_data"), captures)


def type_queue(proposals: DataFrame, entities: DataFrame, captures: DataFrame, status: str = "pending") -> DataFrame:
    """Adds candidate_name, candidate_type, candidate_status and the capture's content; all null where they are gone."""
    e = entities.select(F.col("id").alias("candidate_entity_id"), F.col("canonical_name").alias("candidate_name"), F.col("type").alias("candidate_type"), F.col("status").alias("candidate_status"))
    c = captures.select(F.col("id").alias("capture_id"), F.col("content").alias("evidence_content"))
    return proposals.filter(F.col("status") == status).join(e, "candidate_entity_id", "left").join(c, "capture_id", "left")


def negation_queue(proposals: DataFrame, entities: DataFrame, facts: DataFrame, captures: DataFrame, status: str = "pending") -> DataFrame:
    """Adds the entity's name, the facts that a negation may mean (candidate_ids: JSON list; those that are there), and up to SHOWN_FACTS active facts
    of the entity, by predicate then id, in which the one that was meant may hide."""
    out = proposals.filter(F.col("status") == status)
    names = entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"))
    wanted = out.select("id", F.explode(F.array_distinct(F.from_json("candidate_ids", "array<long>"))).alias("fact"))
    meant = wanted.join(facts.select(F.col("id").alias("fact"), "predicate", "value", "confidence"), "fact").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("fact").alias("id"), "predicate", "value", "confidence"))).alias("candidates"))
    asked = out.select("entity_id").distinct()
    active = facts.filter("not obsoleted and not archived").join(asked, "entity_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("predicate", "id"))
    alive = active.withColumn("place", place).filter(F.col("place") <= SHOWN_FACTS).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "predicate", "value"))), lambda x: F.struct(x["id"].alias("id"), x["predicate"].alias("predicate"), x["value"].alias("value"))).alias("entity_facts"))
    out = out.join(names, "entity_id", "left").join(meant, "id", "left").join(alive, "entity_id", "left")
    return with_excerpt(out.drop("candidate_ids"), captures)


def attach_queue(proposals: DataFrame, entities: DataFrame, captures: DataFrame, status: str = "pending") -> DataFrame:
    """Adds project_name and capture_content."""
    e = entities.select(F.col("id").alias("project_id"), F.col("canonical_name").alias("project_name"))
    c = captures.select(F.col("id").alias("capture_id"), F.col("content").alias("capture_content"))
    return proposals.filter(F.col("status") == status).join(e, "project_id", "left").join(c, "capture_id", "left")


def decided(proposals: DataFrame, decisions: DataFrame, usable: Column, unusable: str) -> DataFrame:
    """``decisions`` (seq, id, action accept or reject, name) with the proposal's columns as ``p`` and ``outcome``.

    A proposal is settled by the first decision that can settle it: any rejection, or an acceptance that is ``usable`` (over
    the columns of both).  Outcomes: accepted, rejected, not_found, already_accepted, already_rejected, or ``unusable`` for an
    acceptance that came too early to be right; such a proposal is still open.
    """
    row = proposals.select(F.col("id").alias("pid"), F.struct(*proposals.columns).alias("p"))
    met = decisions.join(row, F.col("id") == F.col("pid"), "left").drop("pid")
    fits = met.withColumn("fits", F.col("p").isNotNull() & (F.col("p.status") == "pending") & ((F.col("action") == "reject") | F.coalesce(usable, F.lit(False))))
    first = fits.filter("fits").groupBy("id").agg(F.min(F.struct("seq", "action")).alias("first"))
    told = fits.join(first, "id", "left")
    done = lambda c: F.concat(c, F.lit("ed"))
    outcome = F.when(F.col("p").isNull(), "not_found").when(F.col("p.status") != "pending", F.concat(F.lit("already_"), F.col("p.status")))
    outcome = outcome.when(F.col("seq") == F.col("first.seq"), done(F.col("action"))).when(F.col("seq") > F.col("first.seq"), F.concat(F.lit("already_"), done(F.col("first.action")))).otherwise(unusable)
    return told.withColumn("outcome", outcome).select("seq", "id", "action", "name", "p", "outcome")


def settled(proposals: DataFrame, told: DataFrame) -> DataFrame:
    """The proposals with the status that decisions gave them."""
    new = told.filter("outcome in ('accepted', 'rejected')").select("id", F.col("outcome").alias("new"))
    return proposals.join(new, "id", "left").withColumn("status", F.coalesce("new", "status")).select(*proposals.columns)


def types_decided(proposals: DataFrame, entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions with outcome, entities after, types to know): an accepted type (the decision's name, else the proposed one) is the candidate's and makes it
    active; a rejection archives the candidate.  A blank type is ``invalid``."""
    wanted = F.trim(F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("p.proposed_type"), F.lit("")))
    told = decided(proposals, decisions, wanted != "", "invalid")
    taken = told.filter("outcome in ('accepted', 'rejected')").withColumn("type", wanted)
    # an entity may have several proposals: the last decision stands
    changes = taken.filter("p.candidate_entity_id is not null").groupBy(F.col("p.candidate_entity_id").alias("id")).agg(F.max_by("outcome", "seq").alias("did"), F.max_by("type", F.when(F.col("outcome") == "accepted", F.col("seq"))).alias("new_type"))
    after = entities.join(changes, "id", "left").withColumns({"type": F.coalesce("new_type", "type"), "status": F.when(F.col("did") == "accepted", "active").when(F.col("did") == "rejected", "archived").otherwise(F.col("status"))})
    return told, after.select(*entities.columns), taken.filter("outcome = 'accepted'").select("type").distinct()


def creations_decided(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions with outcome, entities born, their facts): an acceptance whose data is no JSON object is ``invalid_payload``."""
    data = F.from_json("p.entity_data", f"aliases array<string>, summary string, facts {_FACT}")
    readable = F.schema_of_variant(F.try_parse_json("p.entity_data")).startswith("OBJECT<")
    told = decided(proposals, decisions, readable & (F.trim("p.canonical_name") != ""), "invalid_payload")
    born = told.filter("outcome = 'accepted'").withColumn("data", data)
    entity = born.select(F.concat(F.lit("new:"), F.col("id").cast("string")).alias("id"), "p.canonical_name", F.col("p.proposed_type").alias("type"), F.coalesce("data.aliases", F.array().cast("array<string>")).alias("aliases"), F.lit("active").alias("status"))
    facts = born.select(F.concat(F.lit("new:"), F.col("id").cast("string")).alias("entity_id"), F.explode("data.facts").alias("f")).select("entity_id", "f.predicate", "f.value")
    return told, entity, facts


def attachments_decided(proposals: DataFrame, entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with outcome, project entries to add): an acceptance whose project is gone is ``gone``."""
    there = entities.select(F.col("id").alias("project_id"), F.lit(True).alias("there"))
    known = proposals.join(there, "project_id", "left").fillna(False, ["there"])
    told = decided(known, decisions, F.col("p.there"), "gone")
    return told, told.filter("outcome = 'accepted'").select("p.project_id", "p.content", "p.capture_id")
