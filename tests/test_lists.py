"""Options of lists, pages of changes, nested answers."""

import pytest

from tessera.functions.filters import clamped, list_notes
from tessera.operators.evaluation import asserted_axes, durable_count, nested_facts
from tessera.operators.facts import rewrite_predicates
from tessera.sources.files import pull_pages

NOTES = "id int, created_at int, title string, content string, entities_mentioned string, kind string, review_status string, archived boolean"


def test_note_options(spark):
    notes = spark.createDataFrame(
        [
            (1, 1, None, "The cat", '["Ann", "Bob"]', "note", "confirmed", False),
            (2, 2, "THE end", None, '["Anna"]', "note", None, False),
            (3, 2, "the", "x", "broken", "task", "pending", False),
            (4, 9, "the", "x", None, "note", "confirmed", True),
        ],
        NOTES,
    )
    ids = lambda **o: [r["id"] for r in list_notes(notes, **o).collect()]
    assert ids() == [2, 1] and ids(limit=-5) == [2] and ids(q="the") == [2, 1]
    assert ids(mention="Ann") == [1] and ids(review_status="pending") == [3] and ids(kind="episode") == []
    with pytest.raises(ValueError, match="kind"):
        list_notes(notes, kind="memo")
    with pytest.raises(ValueError, match="review_status"):
        list_notes(notes, review_status="open")
    assert [clamped(n) for n in (0, 7, 900)] == [1, 7, 200]


def test_change_pages(spark):
    changes = spark.createDataFrame([(s,) for s in (9, 3, 4, 20, 11, 5)], "seq int")
    pages = [(cursor, sorted(r["seq"] for r in page.collect())) for cursor, page in pull_pages(changes, 3, 2)]
    assert pages == [(5, [4, 5]), (11, [9, 11]), (20, [20])]
    assert list(pull_pages(changes, 20, 2)) == []


def test_predicates_rewritten(spark):
    facts = spark.createDataFrame([(1, "is_vegan", "true"), (2, "age", None), (3, None, "x")], "id int, predicate string, value string")
    plan = spark.createDataFrame([("is_vegan", "diet", "vegan")], "old string, wide string, filled string")
    assert sorted(map(tuple, rewrite_predicates(facts, plan).collect())) == [(1, "diet", "vegan", True), (2, "age", None, False), (3, None, "x", False)]


def test_nested_answers(spark):
    answers = spark.createDataFrame(
        [
            (1, '{"entities":[{"canonical_name":"a","facts":[{"predicate":"p","value":"v"}]},{"canonical_name":"b"}],"relations":[{"source":"a"}]}'),
            (2, '{"entities":null}'),
            (3, "no JSON"),
            (4, None),
        ],
        "id int, answer string",
    )
    assert [tuple(r) for r in nested_facts(answers).collect()] == [(1, "a", "p", "v")]
    assert [r[0] for r in answers.orderBy("id").select(durable_count(answers["answer"])).collect()] == [2, 0, 0, 0]
    cases = spark.createDataFrame([(1, '{"owner":null,"other":1}'), (2, "{}"), (3, None)], "id int, body string")
    assert [tuple(r) for r in asserted_axes(cases).collect()] == [(1, "owner", "R1e")]
