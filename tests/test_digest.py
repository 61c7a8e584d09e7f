"""Weekly digest, blocking gate, snapshot severities and the owner of a cycle on small frames."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tessera.operators import digest, gate, snapshots
from tessera.streaming import owner

TODAY = date(2026, 6, 17)
NOTE = "id long, title string, kind string, event_date date, recurring boolean, owner string, archived boolean, created_at date"
NOTES = [
    (1, "Vivatech fair", "event", date(2026, 6, 20), False, None, False, TODAY),
    (2, "Far talk", "event", date(2026, 7, 20), False, None, False, TODAY),
    (3, "Redo the design", "task", None, False, None, False, date(2026, 5, 1)),
    (4, "Done", "task", None, False, None, True, TODAY),
    (5, "Birthday of CICI", "event", date(1990, 6, 19), True, None, False, TODAY),
    (6, "Tom's errand", "task", date(2026, 6, 18), False, "Tom", False, TODAY),
    (7, "Digest of the week", "digest", None, False, None, False, TODAY),
    (8, "A week ahead", "event", date(2026, 6, 24), False, None, False, date(2026, 6, 9)),
    (9, "Leap", "event", date(2024, 2, 29), True, None, False, date(2026, 6, 10)),
]
ENTITY = "id string, canonical_name string, type string, created_at date, last_mentioned date, mention_count long"
ENTITIES = [("m", "Maxwell", "person", date(2026, 6, 15), date(2026, 6, 16), 5), ("o", "Old", "person", date(2026, 5, 15), date(2026, 5, 10), 9), ("c", "Cici", "person", date(2026, 6, 17), None, 1), ("b", "Ben", "person", date(2025, 1, 1), None, 1)]
FACT = "id long, entity_id string, predicate string, value string, obsoleted boolean, created_at date"
FACTS = [(1, "m", "works_at", "X", False, date(2026, 6, 16)), (2, "c", "has_birthday", "1990-06-19", False, TODAY), (3, "b", "has_birthday", "1990-06-18", False, date(2020, 1, 1)), (4, "o", "has_birthday", "1985-07-17", False, TODAY), (5, "m", "has_birthday", "someday", False, TODAY), (6, "m", "has_birthday", "1980-06-20", True, TODAY)]


def gathered(spark, notes, facts, entities, captures=0, validated=0):
    c = spark.createDataFrame([(TODAY,)] * captures, "created_at date")
    v = spark.createDataFrame([(TODAY, i < validated) for i in range(3)], "created_at date, confirmed boolean")
    return digest.gather(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(facts, FACT), spark.createDataFrame(notes, NOTE), c, v, TODAY)


def test_weekly_gather(spark):
    week = gathered(spark, NOTES, FACTS, ENTITIES, captures=2, validated=1)
    got = {}
    for r in week.collect():
        got.setdefault(r["part"], []).append(r)
    titles = lambda part: sorted(r["title"] for r in got.get(part, []))
    assert titles("new_entity") == ["Cici", "Maxwell"] and titles("trend") == ["Maxwell"]
    assert titles("upcoming") == ["A week ahead", "Birthday of CICI", "Birthday: Ben", "Vivatech fair"]
    assert {r["title"]: (r["day"], r["kind"]) for r in got["upcoming"]}["Birthday: Ben"] == ("2026-06-18", "birthday")
    assert titles("open_task") == ["Redo the design"] and "Digest of the week" not in titles("new_note")
    assert {r["id"]: r["n"] for r in got["count"]} == {"captures": 2, "new_entities": 2, "new_facts": 4, "validated_facts": 1, "new_notes": 6}
    assert digest.has_content(week)


def test_an_empty_week(spark):
    assert not digest.has_content(gathered(spark, [], [], [("o", "Old", "person", date(2020, 1, 1), TODAY, 3)], validated=2))
    assert digest.has_content(gathered(spark, [], [], [], captures=1))


def test_one_digest_a_week(spark):
    row = "title string, content string, created_at int"
    old, new = spark.createDataFrame([("week 1", "a", 1), ("week 2", "b", 5)], row), spark.createDataFrame([("week 2", "c", 5), ("week 3", "d", 6)], row)
    assert {tuple(r) for r in digest.upserted(old, new).collect()} == {("week 1", "a", 1), ("week 2", "c", 5), ("week 3", "d", 6)}
    days = spark.createDataFrame([(date(2026, 6, 17),), (date(2026, 6, 15),), (date(2026, 6, 14),)], "d date")
    assert [str(r[0]) for r in days.select(digest.week_start(F.col("d"))).collect()] == ["2026-06-15", "2026-06-15", "2026-06-08"]


GOOD = '{"memories": [{"note": "n", "kind": "task"}]}'
FINE = (None, 1000, "end", True)
GATE = [
    (1, "{}", GOOD, FINE, FINE, None),
    (2, "{}", GOOD, ("boom", 1000, "end", True), ("late", 0, None, None), "note: call failed: boom"),
    (3, "{}", GOOD, (None, 4096, "end", True), FINE, "note: prompt longer than the window"),
    (4, "{}", GOOD, (None, 99, "end", True), FINE, "note: prompt cut on its way"),
    (5, "{}", GOOD, (None, None, "max_tokens", True), FINE, "note: output cut"),
    (6, "{}", GOOD, FINE, (None, None, None, None), "graph: no JSON"),
    (7, "{}", None, FINE, FINE, "no answer"),
    (8, "{}", '{"memories": [{"note": "n"}, {"note": "m", "kind": "reflection"}]}', FINE, FINE, "kind: reflection"),
    (9, '{"drop_guard": true}', '{"language": "en"}', FINE, FINE, "no durable trace"),
    (10, '{"drop_guard": false}', '{"language": "en"}', FINE, FINE, None),
    (11, '{"drop_guard": true}', '{"relations": [{"predicate": "p"}]}', FINE, FINE, None),
    (12, '{"drop_guard": true}', '{"cancels_action": "x"}', FINE, FINE, "no durable trace"),
]


def test_gate(spark):
    half = lambda h: f"{h}_error string, {h}_prompt_tokens long, {h}_stop string, {h}_parsed boolean"
    rows = spark.createDataFrame([(i, c, a, *n, *g) for i, c, a, n, g, _ in GATE], f"id long, c string, a string, {half('note')}, {half('graph')}")
    got = {r["id"]: r["reason"] for r in gate.gated(rows, "c", "a", {"note": 800, "graph": 800}, 4096).collect()}
    assert got == {i: why for i, *_, why in GATE}


def test_severities(spark):
    case = "id long, note boolean, kind string, input_type string, event_date string, relations long, projects long"
    a = spark.createDataFrame([(1, True, "task", "x", "2024-01-01", 2, 1), (2, True, "note", "x", None, 0, 0), (3, False, "task", "x", None, 1, 0), (4, True, "task", "x", None, 0, 0)], case)
    b = spark.createDataFrame([(1, False, None, "y", None, 1, 1), (2, True, "note", "x", "2024-01-01", 3, 0), (3, False, "note", "x", None, 1, 0)], case)
    fact = "id long, entity string, predicate string, evidence string, position int"
    fa = spark.createDataFrame([(1, "e", "p", "implicit", 1), (1, "e", "p", "explicit", 2), (2, "e", "p", "hedged", 1), (2, "e", "q", None, 2)], fact)
    fb = spark.createDataFrame([(1, "e", "p", "hedged", 1), (2, "e", "p", "explicit", 1), (2, "e", "q", "odd", 2), (2, "f", "p", "implicit", 3)], fact)
    got = {tuple(r) for r in snapshots.severities(a, b, fa, fb).collect()}
    assert got == {
        (1, "regression", "note lost: task"), (1, "warning", "kind task > none"), (1, "warning", "input_type x > y"), (1, "warning", "event_date lost: 2024-01-01"),
        (1, "warning", "facts 2 > 1"), (1, "warning", "relations 2 > 1"), (1, "warning", "evidence p explicit > hedged"), (4, "absent", "absent"),
    }


def test_owner(spark):
    claims = spark.createDataFrame([("s", 1, "a", datetime(2024, 1, 1)), ("s", 2, "b", datetime(2024, 1, 2)), ("s", 3, "a", datetime(2024, 1, 2))], "scope string, id long, device string, at timestamp")
    asked = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c"), ("t", "b")], "scope string, device string")
    assert {tuple(r) for r in owner.guarded(asked, claims).collect()} == {("s", "a", "a", 3, "owner"), ("s", "b", "a", 3, "not_cycle_owner"), ("t", "b", "b", 1, "claimed"), ("t", "c", "b", 1, "not_cycle_owner")}
