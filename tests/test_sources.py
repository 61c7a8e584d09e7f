"""File sources and text functions on hand-made files."""

import json

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources import files


def test_cases(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"id": "a", "text": "x", "owner": null}\n{"id": "b", "text": "y"}\n\nnot json\n')
    (tmp_path / "two.jsonl").write_text('{"id": "b", "text": "z"}\n{"id": "c"}\n{"id": "d", "text": "w", "odd": 1}\n')
    rows = files.read_cases(spark, str(tmp_path), {"id": "string", "text": "string", "owner": "string"}).collect()
    assert sorted((r["set"], r["id"], r["problem"]) for r in rows if r["id"]) == [("one", "a", None), ("one", "b", "repeated id"), ("two", "b", "repeated id"), ("two", "c", "missing field"), ("two", "d", "unknown field")]
    assert [r["problem"] for r in rows if r["id"] is None] == ["broken line"]
    assert [r["asserted"] for r in rows if r["id"] == "a"] == [["id", "text", "owner"]]


def test_tolerant_snapshot_markdown(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('# note\n{"id": 1}\n{"id": \n')
    assert [(r["id"], r["bad"]) for r in files.read_tolerant(spark, str(tmp_path / "t.jsonl"), "id int").collect()] == [(1, None), (None, '{"id": ')]
    (tmp_path / "s.json").write_text(json.dumps({"cases": {"a": {"n": 1}, "b": {"n": None}}}))
    assert {tuple(r) for r in files.read_snapshot(spark, str(tmp_path / "s.json"), "n int").collect()} == {("a", 1), ("b", None)}
    (tmp_path / "m.md").write_text("# T\n| a | b |\n|---|:-:|\n| 1 | x y |\n")
    assert [r["cells"] for r in files.read_markdown_table(spark, str(tmp_path / "m.md")).orderBy("row").collect()] == [["a", "b"], ["1", "x y"]]


def test_unpivot_and_chat(spark, tmp_path):
    cases = spark.createDataFrame([(1, "oui", "yes")], "id int, fr string, en string")
    assert {tuple(r) for r in files.unpivot_languages(cases).collect()} == {(1, "fr", "oui"), (1, "en", "yes")}
    threads = spark.createDataFrame([(1, [("user", None)])], "id int, messages array<struct<role string, text string>>")
    files.write_chat(threads, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"id":1,"messages":[{"role":"user","text":null}]}'


def test_text_functions(spark):
    df = spark.createDataFrame([("Éa çà  Dr. X. see https://a.b/c, https://a.b/c!", "<head><title> A\n B </title></head><nav>n</nav><p>1 &lt; 2 &amp;amp;</p><script>x</script>"), ("", "")], "t string, h string")
    a, b = df.select(text.slug(F.col("t")), text.urls(F.col("t")), text.html_title(F.col("h")), text.html_text(F.col("h")), text.word_count(F.col("t")), text.nullable_text(F.lit(" None "))).collect()
    assert tuple(a) == ("ea-ca-dr-x-see-https-a-b-c-https-a-b-c", ["https://a.b/c"], "A B", "1 < 2 &amp;", 7, None)
    assert tuple(b) == ("", [], "", "", 0, None)
