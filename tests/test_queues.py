"""Queues show what is there and what is gone; decisions settle a proposal once, in order."""

from pyspark.sql import functions as F

from tessera.operators import queues

CAPTURES = [(1, "x" * 300), (2, None)]
FACTS = [(1, "a", "likes", "tea", False, False, 0.9), (2, "a", "likes", "rum", True, False, 0.9), (3, "b", "likes", "tea", False, True, 0.5), (4, "a", "age", "7", False, False, 0.5)]


def captures(spark):
    return spark.createDataFrame(CAPTURES, "id long, content string")


def facts(spark):
    return spark.createDataFrame(FACTS, "id long, entity_id string, predicate string, value string, obsoleted boolean, archived boolean, confidence double")


def entities(spark):
    return spark.createDataFrame([("a", "Ann", "person", "pending"), ("b", "Bob", "person", "active")], "id string, canonical_name string, type string, status string")


def test_predicates_and_renames(spark):
    relations = spark.createDataFrame([("a", "likes", "b"), ("a", "self", "a")], "src string, predicate string, dst string")
    p = spark.createDataFrame([(1, "fact", "likes", "works_at", "pending"), (2, "relation", "likes", "gone", "pending"), (3, "fact", "age", "likes", "accepted")], "id long, kind string, candidate string, existing string, status string")
    got = {r["id"]: (r["candidate_usage"], r["candidate_entities"], r["existing_usage"], r["target_is_family_head"]) for r in queues.predicate_queue(p, facts(spark), relations).collect()}
    assert got == {1: (3, 2, 0, True), 2: (1, 1, 0, False)}
    r = spark.createDataFrame([(1, "a", "Anna", 1, "pending"), (2, "zz", "Z", 9, "pending")], "id long, entity_id string, proposed_name string, capture_id long, status string")
    got = {x["id"]: (x["entity_type"], x["facts_count"], x["relations_count"], len(x["evidence_excerpt"])) for x in queues.rename_queue(r, entities(spark), facts(spark), relations, captures(spark)).collect()}
    assert got == {1: ("person", 2, 2, 280), 2: (None, 0, 0, 0)}


def test_negations(spark):
    p = spark.createDataFrame([(1, "a", "[1,2,99,1]", 1, "pending"), (2, "b", "odd", 2, "pending"), (3, "zz", None, None, "pending")], "id long, entity_id string, candidate_ids string, capture_id long, status string")
    got = {r["id"]: r for r in queues.negation_queue(p, entities(spark), facts(spark), captures(spark)).collect()}
    assert [c["id"] for c in got[1]["candidates"]] == [1, 2] and [f["id"] for f in got[1]["entity_facts"]] == [4, 1] and got[1]["entity_name"] == "Ann"
    assert got[2]["candidates"] is None and got[2]["entity_facts"] is None and got[3]["entity_name"] is None


def test_decisions_on_types(spark):
    p = spark.createDataFrame([(1, "recipe", "a", "pending"), (2, " ", "b", "pending"), (3, "x", "b", "accepted"), (4, "tool", None, "pending")], "id long, proposed_type string, candidate_entity_id string, status string")
    d = spark.createDataFrame([(1, 1, "accept", None), (2, 1, "reject", None), (3, 2, "accept", " "), (4, 2, "accept", "dish"), (5, 3, "reject", None), (6, 9, "accept", None), (7, 4, "reject", None), (8, 4, "accept", None)], "seq long, id long, action string, name string")
    told, after, types = queues.types_decided(p, entities(spark), d)
    assert [(r["seq"], r["outcome"]) for r in told.orderBy("seq").collect()] == [(1, "accepted"), (2, "already_accepted"), (3, "invalid"), (4, "accepted"), (5, "already_accepted"), (6, "not_found"), (7, "rejected"), (8, "already_rejected")]
    assert {(r["id"], r["type"], r["status"]) for r in after.collect()} == {("a", "recipe", "active"), ("b", "dish", "active")} and {r["type"] for r in types.collect()} == {"recipe", "dish"}
    assert {(r["id"], r["status"]) for r in queues.settled(p, told).collect()} == {(1, "accepted"), (2, "accepted"), (3, "accepted"), (4, "rejected")}


def test_decisions_on_creations_and_attachments(spark):
    p = spark.createDataFrame([(1, "Tom", "person", '{"aliases":["T"],"facts":[{"predicate":"p","value":"v"}]}', "pending"), (2, "Odd", "person", "broken", "pending"), (3, "Bare", "place", "{}", "pending")], "id long, canonical_name string, proposed_type string, entity_data string, status string")
    d = spark.createDataFrame([(1, 1, "accept", None), (2, 2, "accept", None), (3, 2, "reject", None), (4, 3, "accept", None)], "seq long, id long, action string, name string")
    told, born, new = queues.creations_decided(p, d)
    assert [r["outcome"] for r in told.orderBy("seq").collect()] == ["accepted", "invalid_payload", "rejected", "accepted"]
    assert sorted(tuple(r) for r in born.collect()) == [("new:1", "Tom", "person", ["T"], "active"), ("new:3", "Bare", "place", [], "active")] and [tuple(r) for r in new.collect()] == [("new:1", "p", "v")]
    a = spark.createDataFrame([(1, "a", "text", 1, "pending"), (2, "zz", "text", 2, "pending")], "id long, project_id string, content string, capture_id long, status string")
    told, entries = queues.attachments_decided(a, entities(spark), d.filter("seq in (1, 2)"))
    assert {r["id"]: r["outcome"] for r in told.collect()} == {1: "accepted", 2: "gone"} and [tuple(r) for r in entries.collect()] == [("a", "text", 1)]
    assert queues.attach_queue(a, entities(spark), captures(spark)).filter(F.col("project_name").isNull()).count() == 1
