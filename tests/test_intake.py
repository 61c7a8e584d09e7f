"""Backlog and valve across restarts, replay store, deficits, families of predicates, states without ids."""

import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import golden, planning, predicates, replay
from tessera.operators.components import components
from tessera.scratch import numbered
from tessera.streaming import captures, trigger

DAY = datetime(2024, 3, 5, 9, 30)


def land(folder, numbers, name):
    rows = [{"event_id": i, "ts": "2024-03-05T09:00:00", "user_id": 1, "event_type": "x", "value": 1.0, "props": "{}"} for i in numbers]
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


class Kept:
    """A consolidation that writes where its run says, and can break off before or after writing."""

    def __init__(self, spark, root):
        self.spark, self.root, self.fail = spark, root, None

    def __call__(self, rows, run, why):
        if self.fail == "before":
            raise RuntimeError("stopped before writing")
        rows.write.mode("overwrite").parquet(f"{self.root}/run={run}")
        if self.fail == "after":
            raise RuntimeError("stopped after writing")

    def runs(self):
        return {k: sorted(v) for k, v in self.rows().items()}

    def rows(self):
        out = {}
        for r in self.spark.read.parquet(str(self.root)).select("run", "event_id").collect():
            out.setdefault(r["run"], []).append(r["event_id"])
        return out


@pytest.fixture
def intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kept = Kept(spark, tmp_path / "out")

    def drain(at, **rule):
        backlog = trigger.Backlog(spark, f"file://{tmp_path}/backlog", kept, **rule)
        stream = captures.read_events(spark, str(tmp_path / "in"), files_a_trigger=1)
        backlog.drain(stream, str(tmp_path / "checkpoint"), lambda: at)
        return backlog

    return tmp_path / "in", kept, drain


def test_small_batches_wait_and_none_is_lost(intake):
    folder, kept, drain = intake
    rule = {"hours": (12,), "most": 14}
    backlog = None
    for k in range(3):  # 5 + 5 + 5 rows, each with a run of its own, a valve of 14
        land(folder, range(5 * k, 5 * k + 5), f"a{k}")
        if k == 0:  # the last pass was just now, so that no schedule is due
            trigger.Backlog.tick(drain(datetime(2024, 3, 5, 12, 0), hours=(12,), most=1), datetime(2024, 3, 5, 12, 0))
        else:
            backlog = drain(datetime(2024, 3, 5, 13 + k, 0), **rule)
    assert kept.runs() == {0: [0, 1, 2, 3, 4]} and backlog.waiting().count() == 10
    land(folder, range(15, 19), "a3")
    drain(datetime(2024, 3, 5, 17, 0), **rule)
    assert kept.runs() == {0: [0, 1, 2, 3, 4], 1: list(range(5, 19))}
    land(folder, [19], "a4")
    drain(datetime(2024, 3, 5, 18, 0), **rule)
    assert sum(map(len, kept.runs().values())) == 19
    drain(datetime(2024, 3, 6, 11, 59), **rule)  # no new rows, not yet due
    assert sum(map(len, kept.runs().values())) == 19
    drain(datetime(2024, 3, 6, 12, 0), **rule)  # no new rows: the schedule takes what waits
    assert kept.runs()[2] == [19] and Counter(x for r in kept.runs().values() for x in r) == Counter(range(20))


@pytest.mark.parametrize("moment", ["before", "after"])
def test_a_pass_that_broke_off_is_repeated(intake, moment):
    folder, kept, drain = intake
    land(folder, range(20), "a")
    kept.fail = moment
    with pytest.raises(Exception, match="stopped"):
        drain(DAY, most=14)
    kept.fail = None
    land(folder, range(20, 25), "b")
    drain(DAY, most=14)
    assert Counter(x for r in kept.runs().values() for x in r) == Counter(range(20)) + Counter(range(20, 25)) or Counter(x for r in kept.runs().values() for x in r) == Counter(range(20))
    drain(datetime(2024, 3, 6, 12, 0), most=14)
    assert Counter(x for r in kept.runs().values() for x in r) == Counter(range(25))


def test_reasons(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    r = lambda queued, stale, last, now, **k: trigger.reason(F.lit(queued), F.lit(stale), at(last), at(now), **k)
    row = spark.range(1).select(
        r(0, 0, None, "2024-03-05 09:00:00").alias("idle"),
        r(0, 2, None, "2024-03-05 09:00:00").alias("stale"),
        r(1, 0, "2024-03-05 00:00:00", "2024-03-05 09:00:00").alias("waits"),
        r(1, 0, "2024-03-04 23:59:59", "2024-03-05 09:00:00").alias("missed"),
        r(1, 0, "2024-03-05 08:00:00", "2024-03-05 12:00:00").alias("noon"),
        r(30, 0, "2024-03-05 08:59:59", "2024-03-05 09:00:00").alias("valve"),
        r(1, 0, "2024-03-05 08:59:59", "2024-03-05 09:00:00", instant=True).alias("instant"),
        r(1, 0, "2024-03-05 08:59:59", "2024-03-05 09:00:00", most=0).alias("least"),
        r(5, 0, None, "2024-03-05 09:00:00").alias("first"),
    ).first()
    assert row.asDict() == {"idle": "", "stale": "stale", "waits": "", "missed": "scheduled", "noon": "scheduled", "valve": "valve", "instant": "instant", "least": "valve", "first": "scheduled"}


def test_replay_of_answers(spark):
    q = spark.createDataFrame([(1, "a", ["x", "y"], "b"), (2, "a", ["x"], "b"), (3, "c", ["x", "y"], "a"), (4, None, ["x"], "a")], "id long, text string, blocks array<string>, corpus string")
    q = replay.positioned(q, ["a", "b"], "corpus", "id")
    key = q.withColumn("key", replay.key(F.col("blocks"), F.col("text")))
    none = spark.createDataFrame([], "key string, answer string, at int")
    answers = key.filter("id = 1").selectExpr("key", "'late' AS answer", "2 AS at").union(key.filter("id = 1").selectExpr("key", "'early' AS answer", "1 AS at"))
    store = none.union(replay.recorded(none, answers))
    assert [r["answer"] for r in store.collect()] == ["early"] and replay.recorded(store, answers).count() == 0
    rows = replay.run(q, store, F.array().cast("array<string>")).orderBy("position").collect()
    assert [(r["id"], r["answer"], r["gaps"], r["conforming"]) for r in rows] == [(3, None, ["missing"], False), (4, None, ["missing"], False), (1, "early", [], True), (2, None, ["missing"], False)]
    missed = replay.unanswered(q.withColumn("position", F.col("id")), store)
    assert sorted(r["position"] for r in missed.collect()) == [2, 3, 4]
    told = replay.tally(rows and replay.run(q, store, F.array().cast("array<string>")), F.col("gap")).collect()
    assert [(r["boundary"], r["n"], r["first"]) for r in told] == [("missing", 3, [2, 3, 4])]


def test_apportionment(spark):
    cells = [("a", "en", 10), ("b", "en", 3), ("c", "fr", 3), ("d", "fr", 1), ("e", "de", 0)]
    m = spark.createDataFrame(cells, "source string, lang string, missing long")
    for batch in (0, 1, 5, 16, 17, 500):
        got = {r["source"]: r["quota"] for r in planning.apportioned(m, ["source", "lang"], batch).collect()}
        n = min(batch, 17)
        assert sum(got.values()) == n and got["e"] == 0
        assert all(abs(got[s] - x * n / 17) < 1 and got[s] <= x for s, _, x in cells)
    five = {r["source"]: r["quota"] for r in planning.apportioned(m, ["source", "lang"], 5).collect()}
    assert five == {"a": 3, "b": 1, "c": 1, "d": 0, "e": 0}
    assert planning.apportioned(m.filter("missing = 0"), ["source", "lang"], 5).first()["quota"] == 0
    assert planning.language_share(100, 11, 0.3, 500, 70) == 24 and planning.language_share(500, 11, 0.3, 500, 70) == 70


def test_fresh_texts(spark):
    corpus = spark.createDataFrame([(1, "Known text")], "id long, text string")
    new = spark.createDataFrame([(2, "known, TEXT!"), (3, "New."), (4, "new"), (5, "..."), (6, None)], "id long, text string")
    assert [tuple(r) for r in planning.fresh(new, corpus, "text", "id").collect()] == [(3, "New.")]


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r["node"]: r["family"] for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(61)}, "x": "x", "y": "x", "z": "z"}


def test_families_and_heads(spark):
    facts = [("lived_in", "a"), ("lived_in", "b"), ("lives_in", "a"), ("has_lived_in", "c"), ("likes_red_tea", "a"), ("likes_green_tea", "b"), ("likes_green_tea", "c"), ("likes_green_cup", "b"), ("lone", "a"), (None, "a")]
    f = spark.createDataFrame(facts, "predicate string, entity_id string")
    chosen = {r["predicate"]: (r["canonical"], r["members"]) for r in predicates.families(predicates.vocabulary(f)).collect()}
    assert chosen["lived_in"] == chosen["has_lived_in"] == ("lives_in", 3)
    assert chosen["likes_red_tea"] == chosen["likes_green_cup"] == ("likes_green_tea", 3) and chosen["lone"] == ("lone", 1)
    near = spark.createDataFrame([("lone", "likes_red_tea")], "a string, b string")
    joined = predicates.families(predicates.vocabulary(f), near)
    assert {r["canonical"] for r in joined.filter("predicate in ('lone', 'likes_red_tea')").collect()} == {"likes_green_tea"}
    assert Counter(r["predicate"] for r in predicates.renamed(f, joined).collect())["likes_green_tea"] == 5


def test_numbers_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = numbered(rows.repartition(6), ["v"], "n").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["n"])] == sorted(i * 7919 % 5003 for i in range(5000)) and {r["n"] for r in got} == set(range(1, 5001))


SPEC = {
    "facts": golden.Table("id", "F", ["entity", "predicate"], {"entity": "entities", "by": "facts"}),
    "entities": golden.Table("id", "U", ["name"], moments=["seen"], sets=["aliases"]),
    "links": golden.Table(None, "", [], {"a": "entities", "b": "entities"}),
}


def state(spark, seed, change=False):
    u = lambda x: f"{seed}-{hash((seed, x))}"
    order = slice(None, None, -1 if seed == "two" else 1)
    entities = [(u("ann"), "ann", ["x", "y"][order], f"2024-{seed}", 0.1 + 0.2), (u("bob"), "bob", [], None, 0.3), (u("bob2"), "bob", ["z"], None, None)]
    facts = [(u("f1"), u("ann"), "likes", "tea", u("f2")), (u("f2"), u("ann"), "likes", "wine" if change else "cups", None), (u("f3"), u("bob"), "age", "7", u("gone"))]
    links = [(u("ann"), u("bob")), (u("bob2"), u("ann"))]
    return {
        "entities": spark.createDataFrame(entities[order], "id string, name string, aliases array<string>, seen string, x double"),
        "facts": spark.createDataFrame(facts[order], "id string, entity string, predicate string, value string, by string"),
        "links": spark.createDataFrame(links[order], "a string, b string"),
    }


def test_states_compare_but_for_ids(spark):
    one, two, three = (golden.normalised(state(spark, s, c), SPEC) for s, c in (("one", False), ("two", False), ("two", True)))
    assert golden.differences(one, two).count() == 0
    assert {tuple(r) for r in golden.fingerprint(one).collect()} == {tuple(r) for r in golden.fingerprint(two).collect()}
    rows = golden.differences(one, three).orderBy("side", "row").collect()
    assert {r["table"] for r in rows} == {"facts"} and any("cups" in r["row"] for r in rows) and any("wine" in r["row"] for r in rows)
    e = {(r["id"], r["name"]): r for r in one["entities"].collect()}
    assert set(e) == {("U1", "ann"), ("U2", "bob"), ("U3", "bob")} and e["U1", "ann"]["seen"] is True and str(e["U1", "ann"]["x"]) == "0.300000"
    f = {r["value"]: r for r in one["facts"].collect()}
    assert f["tea"]["by"] == f["cups"]["id"] and f["7"]["by"] is None and f["7"]["entity"] in ("U2", "U3")
    with pytest.raises(ValueError, match="circle"):
        golden.in_order({"a": golden.Table(refs={"x": "b"}), "b": golden.Table(refs={"y": "a"})})
