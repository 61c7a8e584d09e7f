"""Every rule once true and once false, from JSON lines; absent, null and wrong types apart."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import gaps

NOTE = {"note": "Call Tom", "kind": "task", "owner": None, "event_date": "2024-05-02", "event_recurring": False}
LEA = {"canonical_name": " Léa ", "aliases": ["Lea B"], "type": "Person", "facts": [{"predicate": "lives_in", "value": "Lyon", "persistence_value": 4, "evidence_strength": "explicit"}]}
BAR = {"canonical_name": "Bar", "type": "place", "type_proposal": "cafe", "renamed_to": "Bar Neuf", "facts": [{"predicate": "opened", "value": "2024-05-28", "persistence_value": 1, "evidence_strength": "implicit"}]}
FULL = {
    "language": "FR-fr", "classification_confidence": 0.9, "memories": [NOTE, {**NOTE, "note": "call tom", "kind": "event"}, {"note": " null "}],
    "entities": [LEA, BAR], "relations": [{"from": "Léa", "to": "Tom", "predicate": "Sibling_of", "confidence": 0.6}], "project_entries": [{"x": 1}],
    "resources": [{"url": "https://A.example/", "entity_canonical": "bar", "user_comment": "good coffee"}], "obsoleted_facts": [{"predicate": "works_at", "value": "Acme"}], "cancels_action": "the dentist",
}
BARE = {"language": "null", "classification_confidence": 0.9, "memories": []}

#: case, answer, the gaps: each rule fails once and passes once.
CASES = [
    ({"drop_guard": True}, BARE, ["drop_guard"]), ({"drop_guard": True}, FULL, []), ({"drop_guard": False}, BARE, []),
    ({"note": True}, BARE, ["note"]), ({"note": False}, BARE, []), ({"note": False}, {"cancels_action": "x"}, ["note"]), ({"note": False}, {"cancels_action": " None"}, []),
    ({"kind": "event"}, FULL, ["kind"]), ({"kind": "task"}, FULL, []), ({"kind": "task"}, BARE, []), ({"kind": "note"}, {"cancels_action": "x"}, []), ({"kind": "note"}, {"memories": [{"note": "n", "kind": ""}]}, []),
    ({"memories": 2}, FULL, ["memories"]), ({"memories": 1}, FULL, []), ({"memories": 0}, BARE, []), ({"memories": 1}, {"atomic_note": "alone"}, []), ({"memories": 1}, {"memories": [{"note": ""}], "note": "not read"}, ["memories"]),
    ({"owner": "Tom"}, FULL, ["owner"]), ({"owner": None}, FULL, []), ({"owner": None}, {"note": "n", "owner": "Tom"}, ["owner"]), ({"owner": "Tom"}, {"note": "n", "atomic_note_owner": "Tom"}, []), ({"owner": None}, {"note": "n", "owner": None, "atomic_note_owner": "Tom"}, []), ({"owner": None}, BARE, []),
    ({"recurring": True}, FULL, ["recurring"]), ({"recurring": False}, FULL, []), ({"recurring": False}, BARE, []),
    ({"event_date": None}, FULL, ["event_date: dated"]), ({"event_date": None}, BARE, []), ({"event_date": "2024-05-03"}, FULL, ["event_date"]), ({"event_date": "2024-05-02"}, FULL, []), ({"event_date": "2024-05-02"}, BARE, ["event_date"]),
    ({"language": "en"}, FULL, ["language"]), ({"language": "fr"}, FULL, []), ({"language": None}, BARE, []), ({"language": "fr"}, BARE, ["language"]),
    ({"needs_review": True}, FULL, ["needs_review"]), ({"needs_review": False}, FULL, []), ({"needs_review": True}, BARE, []), ({"needs_review": True}, {**FULL, "classification_confidence": 0.69}, []), ({"needs_review": False}, {"entities": [{"canonical_name": "x"}]}, ["needs_review"]),
    ({"rel": "parent"}, FULL, ["rel parent"]), ({"rel": "brother|sibling"}, FULL, []), ({"rel": ["sibling", "knows|met", 7]}, FULL, ["rel knows|met"]), ({"rel": ""}, BARE, []),
    ({"facts_on": {"léa": 2, "Bar": 1}}, FULL, ["facts_on léa"]), ({"facts_on": {"Léa": 1}}, FULL, []),
    ({"relation_proposed": "parent"}, FULL, ["relation_proposed: absent parent"]), ({"relation_proposed": "sibling"}, FULL, []), ({"relation_proposed": ["sibling"]}, {"relations": [{"predicate": "sibling_of", "confidence": 0.7}]}, ["relation_proposed: certain sibling"]), ({"relation_proposed": "sibling"}, {"relations": [{"predicate": "sibling_of", "confidence": 0}]}, ["relation_proposed: certain sibling"]),
    ({"proj": True}, BARE, ["proj"]), ({"proj": True}, FULL, []),
    ({"facts_min": 4}, FULL, ["facts_min"]), ({"facts_min": 3}, FULL, []), ({"facts_min": 0}, BARE, []),
    ({"entity_expected": ["LÉA", "Tom"]}, FULL, ["entity_expected Tom"]), ({"entity_expected": "lea b"}, FULL, []),
    ({"resource_url": "https://b.example/"}, FULL, ["resource_url"]), ({"resource_url": " HTTPS://a.example/"}, FULL, []),
    ({"resource_url": "https://a.example/", "resource_owner_type": "person"}, FULL, ["resource_owner_type"]), ({"resource_url": "https://a.example/", "resource_owner_type": "Place"}, FULL, []), ({"resource_owner_type": "person"}, FULL, []),
    ({"resource_url": "https://a.example/", "resource_comment": None}, FULL, ["resource_comment: extra"]), ({"resource_url": "u", "resource_comment": None}, {"resources": [{"url": "u"}]}, []),
    ({"resource_url": "https://a.example/", "resource_comment": "tea"}, FULL, ["resource_comment: lost"]), ({"resource_url": "https://a.example/", "resource_comment": "Good"}, FULL, []),
    ({"entity_proposed": "Léa"}, FULL, ["entity_proposed Léa"]), ({"entity_proposed": "x"}, {"note": "n", "entities": [{"canonical_name": "X"}]}, []), ({"entity_proposed": "x"}, {"entities": [{"canonical_name": "X"}]}, ["entity_proposed x"]),
    ({"fact_proposed": "Léa:lives"}, FULL, ["fact_proposed"]), ({"fact_proposed": "x:p"}, {"entities": [{"canonical_name": "x", "facts": [{"predicate": "pp", "evidence_strength": "hedged", "persistence_value": 3}]}]}, []),
    ({"fact_asserted": "bar:opened"}, FULL, ["fact_asserted"]), ({"fact_asserted": "lea b:lives_in"}, FULL, []),
    ({"type_proposal": "Tom"}, FULL, ["type_proposal: absent"]), ({"type_proposal": "Léa"}, FULL, ["type_proposal: asserted"]), ({"type_proposal": "bar"}, FULL, []),
    ({"no_type_proposal": True}, FULL, ["no_type_proposal"]), ({"no_type_proposal": True}, BARE, []),
    ({"no_entity": ["Bar", "Tom"]}, FULL, ["no_entity Bar"]), ({"no_entity": 1}, FULL, []),
    ({"forbidden_value": "lyon"}, FULL, ["forbidden_value"]), ({"forbidden_value": "paris"}, FULL, []),
    ({"forbidden_value": "2024-06-28", "text": "opens on the 28th"}, {**FULL, "memories": [{**NOTE, "kind": "event"}]}, ["forbidden_value"]), ({"forbidden_value": "2024-06-28", "text": "opens on 28 May"}, {**FULL, "memories": [{**NOTE, "kind": "event"}]}, []),
    ({"renamed_to": "Bar Vieux"}, FULL, ["renamed_to"]), ({"renamed_to": "bar neuf "}, FULL, []),
    ({"no_rename": True}, FULL, ["no_rename"]), ({"no_rename": True}, BARE, []),
    ({"obsoletes": "lives_in"}, FULL, ["obsoletes"]), ({"obsoletes": "works_at"}, FULL, []), ({"obsoletes": "Works_At=ACME"}, FULL, []), ({"obsoletes": "works_at=Other"}, FULL, ["obsoletes"]),
    ({"no_obsolete": True}, FULL, ["no_obsolete"]), ({"no_obsolete": True}, BARE, []),
    ({"cancels": "dentist"}, BARE, ["cancels: unnamed"]), ({"cancels": "gym"}, FULL, ["cancels: other"]), ({"cancels": "Dentist"}, FULL, []), ({"cancels": "cancel the dentist today"}, FULL, []),
    ({"no_cancel": True}, FULL, ["no_cancel"]), ({"no_cancel": True}, BARE, []),
    ({"forbidden_predicate": "LIVES"}, FULL, ["forbidden_predicate"]), ({"forbidden_predicate": "born"}, FULL, []),
    ({}, FULL, []), ({"note": True, "proj": True}, BARE, ["note", "proj"]),
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gaps") / "cases.jsonl"
    lines = [{"id": i, "case": json.dumps(c), "answer": json.dumps(a)} for i, (c, a, _) in enumerate(CASES)]
    lines += [{"id": 1000 + i, "case": '{"note": true}', "answer": a} for i, a in enumerate(("{}", "[]", "no json", '"x"', None))]
    path.write_text("\n".join(map(json.dumps, lines)))
    rows = spark.read.schema("id long, case string, answer string").json(str(path))
    return {r["id"]: r["gaps"] for r in gaps.with_gaps(rows, "case", "answer", F.lit("2024-06-01").cast("date")).collect()}


def test_every_rule_fails_and_passes(found):
    wrong = [(c, want, found[i]) for i, (c, _, want) in enumerate(CASES) if found[i] != want]
    assert not wrong


def test_unusable_answers(found):
    assert all(found[1000 + i] == [gaps.UNUSABLE] for i in range(5))


def test_all_rules_are_covered(spark):
    names = {n for n, *_ in gaps.rules(gaps.Case(F.col("__case"), F.col("__keys")), gaps.Answer(), F.current_date())}
    failed = {next(n for n in sorted(names, key=len, reverse=True) if g.startswith(n)) for _, _, w in CASES for g in w}
    assert len(names) == 37 and failed == names


def test_skipped_axes(spark):
    rows = spark.createDataFrame([('{"drop_guard": true, "note": true}', '{"language": "en"}')], "c string, a string")
    assert gaps.with_gaps(rows, "c", "a", F.current_date(), ("drop_guard",)).first()["gaps"] == ["note"]
