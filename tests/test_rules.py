"""Text, predicate and date rules on cases where simpler rules differ."""

from pyspark.sql import functions as F

from tessera.functions import temporal, text


def of(spark, rule, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", rule(F.col("v")).alias("o")).orderBy("i").collect()]


def test_signatures(spark):
    found = of(spark, text.predicate_signature, "is_cousin_of", "cousin_of", "were_works_at", "Worked_at the", "does_run", "born_on", "is_has_pets_for")
    assert found == ["cousin", "cousin", "at work", "at work", "does run", "born on", "pets"]


def test_sentences(spark):
    assert of(spark, text.sentence_count, "Pi is 3.5 today.", "M. Dupont came. He left!", "One... Two?! Three", "", "See p. 3, cf. etc. here.") == [1, 2, 3, 0, 1]


def test_language(spark):
    assert of(spark, text.language_guess, "le chat et la souris", "the cat is on it", "l'an", "a de") == ["fr", "en", "undecided", "undecided"]


def test_headings_and_fences(spark):
    assert of(spark, text.without_headings, "# T\na\n  ## U\nb # c") == ["a\nb # c"]
    whole = lambda c: text.fenced_json(c, F.lit("end_turn"))
    assert of(spark, whole, '```json\n{"a": 1}\n```', ' {"a": 1}\n', "[1]", '{"a": ', None, '```\n{"b": 2}') == ['{"a": 1}', '{"a": 1}', None, None, None, '{"b": 2}']
    assert of(spark, lambda c: text.fenced_json(c, F.lit("max_tokens")), '{"a": 1}') == [None]


def test_bare_days(spark):
    rows = [("2024-03-20", "episode", "le 20"), ("2024-03-15", "episode", "le 15"), ("2024-03-15", "event", "the 15th"), ("2024-03-10", "task", "le 10"), ("2024-03-10", "task", "le 10 août"), ("2024-03-10", "fact", "10"), ("2024-01-31", "event", "le 31"), ("2024-01-10", "event", None)]
    day = temporal.month_snap(F.col("d").cast("date"), F.lit("2024-03-15").cast("date"), F.col("k"), F.col("t")).cast("string")
    found = [r["o"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, k string, t string").select("i", day.alias("o")).orderBy("i").collect()]
    assert found == ["2024-02-20", "2024-03-15", "2024-04-15", "2024-04-10", "2024-03-10", "2024-03-10", "2024-01-31", "2024-02-10"]
