"""Facts and consolidation: M05, F02-F06, F11-F14, F18, F19."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_confidence(evidence: Column, persistence: Column, existing: Column, mentions: Column) -> Column:
    """By evidence, entity and persistence; hedged evidence stays at 0.84 or less."""
    base = F.when(evidence == "hedged", 0.65).when(evidence == "implicit", 0.40).otherwise(0.92)
    lasting = F.when(persistence == 5, 0.20).when(persistence == 4, 0.15).when(persistence == 3, 0.05).when(persistence == 1, -0.10).otherwise(0.0)
    raw = base + F.when(existing, 0.05).otherwise(0.0) + F.least(mentions * 0.02, F.lit(0.05)) + lasting
    raw = F.when(evidence == "hedged", F.least(raw, F.lit(0.84))).otherwise(raw)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)


def destination(confidence: Column) -> Column:
    """F04."""
    return F.when(confidence > 0.85, "facts").when(confidence >= 0.5, "pending").otherwise("review")


def entity_gate(named: Column, owns_resource: Column, n_facts: Column, max_persistence: Column, only_predicate: Column, has_memory: Column) -> Column:
    """F02, §8.2: created, proposed or ignored."""
    floor = F.when(n_facts <= 1, 4).otherwise(2)
    date_only = (n_facts == 1) & only_predicate.isin("event_date", "occurs_on")
    lasting = (n_facts > 0) & (F.coalesce(max_persistence, F.lit(3)) >= floor) & ~date_only
    return F.when(named | owns_resource | lasting, "created").when(has_memory, "proposed").otherwise("ignored")


def reinforce(facts: DataFrame) -> DataFrame:
    """F03, first half: identical (entity, predicate, value) become one fact with the highest confidence and the last confirmation."""
    keys = [F.col("entity_id"), F.lower(F.trim("predicate")).alias("predicate"), F.lower(F.trim("value")).alias("value")]
    return facts.groupBy(*keys).agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"), F.max("created_at").alias("last_confirmed"), F.count("*").alias("n"))


def supersede(facts: DataFrame, family: str = "family") -> DataFrame:
    """F03, second half, §8.4: a newer fact of a single-valued family obsoletes every active one that is not more confident.

    id, obsoleted_by.  A fact is obsoleted by the first later one at least as confident, whichever are active in
    between, so the fold is a next-greater-or-equal search with a stack.  Families are hashed to partitions and
    streamed in order; what is held is the stack of one family (facts in falling confidence), not the family.
    """
    keys = ["entity_id", family]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[float, int]] = []
        at: tuple | None = None
        for f in frames:
            done: list[tuple[int, int | None]] = []
            for key, i, c in zip(zip(f["entity_id"], f[family], strict=True), f["id"], f["confidence"], strict=True):
                if key != at:
                    done += [(x, None) for _, x in stack]
                    stack, at = [], key
                while stack and stack[-1][0] <= c:
                    done.append((stack.pop()[1], i))
                stack.append((c, i))
            yield pd.DataFrame({"id": [x for x, _ in done], "obsoleted_by": pd.array([y for _, y in done], dtype="Int64")})
        yield pd.DataFrame({"id": [x for _, x in stack], "obsoleted_by": pd.array([None] * len(stack), dtype="Int64")})

    rows = facts.select(*keys, "id", "confidence", "created_at").repartition(*keys).sortWithinPartitions(*keys, "created_at", "id")
    return rows.mapInPandas(fold, "id long, obsoleted_by long")


def reroute(df: DataFrame, merges: DataFrame, *columns: str) -> DataFrame:
    """replaces absorbed ids by their survivors in the given columns. ``merges``: absorbed, survivor."""
    for c in columns:
        m = merges.select(F.col("absorbed").alias(c), F.col("survivor").alias("__to"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return df


def swap_names(notes: DataFrame, names: DataFrame) -> DataFrame:
    """``notes`` (id, mentions) with old names (old, new; an old name once) replaced, of repeats the first kept. Null and empty lists stay."""
    each = notes.select("id", F.posexplode("mentions").alias("pos", "old")).join(names, "old", "left")
    order = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "old").alias("name"))))  # the names of one note
    swapped = each.groupBy("id").agg(F.array_distinct(F.transform(order, lambda x: x["name"])).alias("__new"))
    return notes.join(swapped, "id", "left").withColumn("mentions", F.coalesce("__new", "mentions")).drop("__new")


def accept_merges(entities: DataFrame, facts: DataFrame, relations: DataFrame, notes: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """the four tables after ``merges`` (absorbed, survivor; an absorbed id once) were accepted.

    Facts and both ends of relations go to the survivor, notes (id unique, mentions: names) name it once, it takes the absorbed
    names that it lacks as aliases, in their order, and the absorbed entity (id, canonical_name, aliases, merged_into_id) stays as a
    tombstone. Merges with an unknown side or with itself are left out.
    """
    known = entities.select("id", "canonical_name")
    sides = merges.filter("absorbed <> survivor").join(known.toDF("absorbed", "old"), "absorbed").join(known.toDF("survivor", "new"), "survivor")
    ids = sides.select("absorbed", "survivor")
    taken = sides.groupBy(F.col("survivor").alias("id")).agg(F.array_sort(F.collect_set("old")).alias("__taken"))
    gone = ids.select(F.col("absorbed").alias("id"), F.col("survivor").alias("__to"))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    after = entities.join(taken, "id", "left").join(gone, "id", "left").withColumns({
        "aliases": F.when(F.col("__taken").isNotNull(), F.concat(aliases, F.array_except("__taken", aliases))).otherwise(F.col("aliases")),
        "merged_into_id": F.coalesce("__to", "merged_into_id"),
    })
    names = sides.filter("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    return {
        "entities": after.drop("__taken", "__to"),
        "facts": reroute(facts, ids, "entity_id"),
        "relations": reroute(relations, ids, "src", "dst"),
        "notes": swap_names(notes, names),
    }


def one_token_pairs(predicates: DataFrame) -> DataFrame:
    """A, b: predicates of three tokens or more that differ in exactly one, by joining on signatures with a wildcard."""
    tokens = F.split("predicate", "_")
    sized = predicates.select("predicate", tokens.alias("t")).filter(F.size("t") >= 3)
    wild = sized.select("predicate", F.posexplode("t").alias("pos", "tok"), "t")
    wild = wild.withColumn("key", F.concat_ws("_", F.transform("t", lambda x, i: F.when(i == F.col("pos"), "*").otherwise(x))))
    x, y = wild.select("key", "pos", F.col("predicate").alias("a")), wild.select("key", "pos", F.col("predicate").alias("b"))
    return x.join(y, ["key", "pos"]).filter("a < b").select("a", "b").distinct()


def first_match(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Name, id: an entity by canonical name, else by alias; ties to the smaller id. ``entities``: id, canonical_name, aliases."""
    names = entities.select("id", F.lower("canonical_name").alias("key"), F.lit(0).alias("prio"))
    names = names.unionByName(entities.select("id", F.explode("aliases").alias("key"), F.lit(1).alias("prio")).withColumn("key", F.lower("key")))
    hits = wanted.withColumn("key", F.lower("name")).join(names, "key")
    order = Window.partitionBy("name").orderBy("prio", "id")
    return hits.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("name", "id")


def rewrite_predicates(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """Facts under a predicate of the plan (old, wide, filled; an old predicate once) take the wide one and the filled value,
    whatever value they had. ``stale`` marks them, as their entity needs a new summary."""
    hit = F.col("old").isNotNull()
    joined = facts.join(plan, facts["predicate"] == plan["old"], "left")
    return joined.withColumns({"predicate": F.coalesce("wide", "predicate"), "value": F.when(hit, F.col("filled")).otherwise(F.col("value")), "stale": hit}).drop("old", "wide", "filled")
