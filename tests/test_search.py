"""Served search, units and parts of nearest neighbours, merges."""

from tessera.operators import search
from tessera.operators.facts import accept_merges
from tessera.operators.knn import block_knn

SCHEMA = "id long, embedding array<float>, type long, source int, owner long"
VECTORS = [(1, [1.0, 0.0], 0, 0, 7), (2, [0.8, 0.6], 0, 0, 7), (3, [0.6, 0.8], 0, 0, 8), (4, [0.0, 1.0], 0, 1, 4), (5, None, 0, 1, 5), (6, [], 0, 2, 6), (7, [0.0, 1.0, 0.0], 0, 2, 7)]
ASKED = [(1, [1.0, 0.0], 0), (-1, None, None), (-2, None, None), (-3, None, None)]


def test_units_and_parts(spark):
    v, q = spark.createDataFrame(VECTORS, SCHEMA), spark.createDataFrame(ASKED, "id long, embedding array<float>, type long")
    hits = {(r["q"], r["source"], r["id"], r["sim"], r["rank"]) for r in block_knn(q, v, 1, unit="owner", part="source").collect()}
    assert hits == {(1, 0, 7, 0.8, 1), (1, 1, 4, 0.0, 1)}  # the query's own vector counts for no unit
    assert block_knn(q, v.limit(0), 3, unit="owner", part="source").count() == 0 and block_knn(q.limit(0), v, None).count() == 0


def test_search_falls_back_to_text(spark):
    v, q = spark.createDataFrame(VECTORS, SCHEMA), spark.createDataFrame(ASKED, "id long, embedding array<float>, type long")
    texts = spark.createDataFrame([("note", 1, "50% OFF", 3), ("inbox", 2, "50% off", 4), ("note", 3, None, 9), ("note", 4, "500 off", 8)], "kind string, id long, content string, created_at long")
    found, woken = search.search_memory(q, v, texts, {-1: "50% off", -2: "absent", 1: "off"}, limit=1)
    assert {tuple(r) for r in found.collect()} == {(1, "note", 7, 0.6838, 1), (-1, "inbox", 2, None, 1)}
    assert {r["id"] for r in woken.collect()} == {7}
    assert search.search_memory(q, v, texts, {})[0].filter("q < 0").count() == 0


def test_merge_proposals(spark):
    rows = [(1, 0, "Dupont", [1.0, 0.0]), (2, 0, "Marie DUPONT", [0.0, 1.0]), (3, 0, "dupont", None), (4, 1, "Dupont", [1.0, 0.0]), (5, 0, "Dup", [1.0, 0.0]), (6, 0, None, [0.0, 1.0]), (7, 0, "", [0.0, 1.0])]
    e = spark.createDataFrame(rows, "id long, type long, name string, embedding array<float>")
    done = spark.createDataFrame([(7, 6)], "candidate long, existing long")
    got = {(r["candidate"], r["existing"], r["reason"]) for r in search.merge_proposals(e, done).collect()}
    assert got == {(2, 1, "name_substring"), (3, 1, "name_equal"), (5, 1, "embedding"), (6, 2, "embedding"), (7, 2, "embedding")}


def test_accept_merges(spark):
    e = spark.createDataFrame([("a", "A", ["x"], None), ("b", "B", None, None), ("c", "x", [], None), ("d", "D", None, None)], "id string, canonical_name string, aliases array<string>, merged_into_id string")
    facts = spark.createDataFrame([(1, "b"), (2, "d")], "id int, entity_id string")
    relations = spark.createDataFrame([("b", "c"), ("d", None)], "src string, dst string")
    notes = spark.createDataFrame([(1, ["B", "D", "A"]), (2, None), (3, []), (4, ["D", "D"])], "id int, mentions array<string>")
    merges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "nowhere")], "absorbed string, survivor string")
    out = {k: {tuple(map(str, r)) for r in v.select(*sorted(v.columns)).collect()} for k, v in accept_merges(e, facts, relations, notes, merges).items()}
    assert out["entities"] == {("['x', 'B']", "A", "a", "None"), ("None", "B", "b", "a"), ("[]", "x", "c", "a"), ("None", "D", "d", "None")}
    assert out["facts"] == {("a", "1"), ("d", "2")} and out["relations"] == {("a", "a"), ("None", "d")}
    assert out["notes"] == {("1", "['A', 'D']"), ("2", "None"), ("3", "[]"), ("4", "['D']")}
