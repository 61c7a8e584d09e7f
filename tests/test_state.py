"""Facts, mutations, time, evaluation and replication on small frames with nulls, ties and repeats."""

import json

from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.operators import evaluation, facts, state
from tessera.operators.asof import asof_join
from tessera.streaming import captures, lww


def test_supersede_compares_with_the_active_fact(spark):
    rows = [(1, "e", "f", 0.9, 1), (2, "e", "f", 0.6, 2), (3, "e", "f", 0.9, 3), (4, "x", "f", 0.1, 1)]
    f = spark.createDataFrame(rows, "id long, entity_id string, family string, confidence double, created_at int")
    for n in (1, 4):
        got = {r["id"]: r["obsoleted_by"] for r in facts.supersede(f.repartition(n)).collect()}
        assert got == {1: 3, 2: 3, 3: None, 4: None}
    assert facts.supersede(f.limit(0)).count() == 0


def test_confidence_and_gate(spark):
    r = spark.range(1).select(
        facts.base_confidence(F.lit("hedged"), F.lit(5), F.lit(True), F.lit(9)).alias("hedged"),
        facts.base_confidence(F.lit("stated"), F.lit(1), F.lit(False), F.lit(0)).alias("fleeting"),
        facts.entity_gate(F.lit(False), F.lit(False), F.lit(1), F.lit(3), F.lit("x"), F.lit(True)).alias("three"),
        facts.entity_gate(F.lit(False), F.lit(False), F.lit(1), F.lit(4), F.lit("x"), F.lit(True)).alias("four"),
        facts.entity_gate(F.lit(False), F.lit(False), F.lit(1), F.lit(5), F.lit("event_date"), F.lit(False)).alias("dated"),
    ).first()
    assert (r["hedged"], r["fleeting"], r["three"], r["four"], r["dated"]) == (0.84, 0.82, "proposed", "created", "ignored")


def test_mutations(spark):
    s = spark.createDataFrame([(1, 5, "a"), (2, 5, None)], "k int, at int, v string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 4, "c"), (3, 1, "d")], "k int, at int, v string")
    assert {tuple(r) for r in state.upsert_latest(s, b, "k", "at").collect()} == {(1, 5, "b"), (2, 5, None), (3, 1, "d")}
    batch = spark.createDataFrame([(1, 1), (9, 2), (9, 3)], "k int, seq int")
    assert sorted((r["k"], r["seq"], r["outcome"]) for r in state.insert_or_ignore(s, batch, "k").collect()) == [(1, 1, "duplicate"), (9, 2, "queued"), (9, 3, "duplicate")]
    p = spark.createDataFrame([(1, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in state.patch(s, p, "k", "v").collect()} == {1: None, 2: None}


def test_decay_bounds_and_recurrence(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    r = spark.range(1).select(
        temporal.decay(now, F.expr("timestamp'2023-06-02 00:00:00'")).alias("year"),
        temporal.decay(now, F.expr("timestamp'2024-05-31 00:00:00'")).alias("day"),
        temporal.decay(now, F.expr("timestamp'2025-01-01 00:00:00'")).alias("future"),
        temporal.next_yearly(F.lit("2020-02-29").cast("date"), F.lit("2023-01-01").cast("date")).cast("string").alias("leap"),
        temporal.reactivated(now, F.expr("timestamp'2024-05-30 00:00:00'"), 0.5).cast("string").alias("half"),
    ).first()
    assert r["year"] < 0.05 and r["day"] > 0.9 and r["future"] == 1.0 and r["leap"] == "2023-02-28" and r["half"] == "2024-05-31 00:00:00"


def test_split_keeps_texts_together(spark):
    rows = [(i, f"T{i % 7}" if i % 2 else f"t{i % 7} ", "s", i == 3) for i in range(70)]
    c = spark.createDataFrame(rows, "id int, text string, lang string, forced boolean")
    got = evaluation.leak_free_split(c, "text", "lang", F.col("forced"), 0.4, "x").collect()
    parts = {}
    for r in got:
        parts.setdefault(r["text"].strip().lower(), set()).add(r["part"])
    assert len(got) == 70 and all(len(p) == 1 for p in parts.values()) and parts["t3"] == {"train"} and sum(p == {"valid"} for p in parts.values()) == 2


def test_state_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "b int, a string")
    one = evaluation.state_hash(a, "t").first()
    assert one == evaluation.state_hash(a.orderBy(F.desc("b")).select("a", "b"), "t").first()
    assert one != evaluation.state_hash(a.dropDuplicates(), "t").first()


LOG = [
    ("n", "1", "x", "a", "01", "d1"),
    ("n", "1", "x", "b", "03", "d2"),
    ("n", "1", "y", "c", "02", "d1"),
    ("n", "2", "x", "a", "01", "d1"),
    ("n", "2", "-", None, "02", "d1"),
    ("n", "3", "-", None, "02", "d1"),
    ("n", "3", "x", "z", "05", "d1"),
]
SCHEMA = "tbl string, pk string, col string, value string, hlc string, device string"
MERGED = {("n", "1", "x", "b"), ("n", "1", "y", "c"), ("n", "3", "x", "z")}


def test_merge_is_idempotent(spark):
    log = spark.createDataFrame(LOG, SCHEMA)
    assert {tuple(r) for r in lww.merge(log).collect()} == MERGED == {tuple(r) for r in lww.merge(log.union(log)).collect()}


def test_merge_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((LOG[:3], LOG[3:5], [*LOG[5:], *LOG[:2]])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("tbl", "pk", "col", "value", "hlc", "device"), r, strict=True))) for r in part))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = {}

    def apply(batch, _):
        for r in batch.collect():  # a test's rows
            if r["col"] == "-":
                for k in [k for k in rows if k[:2] == (r["tbl"], r["pk"])]:
                    del rows[k]
            else:
                rows[(r["tbl"], r["pk"], r["col"])] = r["value"]

    q = lww.merge_stream(source).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(*k, v) for k, v in rows.items()} == MERGED


def test_capture_stream_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"event_id": i % 3, "ts": f"2024-01-01T00:0{i}:00Z", "user_id": 1, "event_type": "a", "value": 1.0, "props": "{}"} for i in range(6)]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    source = captures.idempotent(captures.read_events(spark, str(tmp_path / "in")))
    q = source.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kept").count() == 3


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), ("a", 7)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 6, None), ("a", 2, 20)], "k string, t int, v int")
    assert sorted(((r["k"], r["t"], r["v"]) for r in asof_join(left, right, "k", "t", "v").collect())) == [("a", 1, None), ("a", 5, 50), ("a", 7, 50), ("b", 3, None)]
