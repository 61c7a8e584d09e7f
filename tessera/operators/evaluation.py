"""Evaluation of labelled cases: E01-E12, E15, E16, E18."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import kept

#: Leading hexadecimal digits of a hash that make a slice of a stratum.
SLICE_DIGITS = 3


def gap_list(asserted: Column, rules: dict[str, tuple[str, Column]]) -> Column:
    """The gaps of a case. ``rules``: gap -> (axis key, violated). An axis counts only where the case asserts it (its key is there)."""
    found = [F.when(F.map_contains_key(asserted, axis) & F.coalesce(bad, F.lit(True)), F.lit(gap)) for gap, (axis, bad) in rules.items()]
    return F.array_compact(F.array(*found))


def boundary_of(gap: Column, prefixes: dict[str, str]) -> Column:
    """The boundary a gap belongs to, by the first prefix that fits."""
    out = F.lit("other")
    for prefix, boundary in reversed(prefixes.items()):
        out = F.when(gap.startswith(prefix), boundary).otherwise(out)
    return out


def diff(old: DataFrame, new: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Key, change (new, removed, changed, same), and how many axes differ. Nulls are equal to nulls."""
    a = old.select(F.col(key).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in axes])
    b = new.select(F.col(key).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in axes])
    j = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    n = sum((F.when(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 0).otherwise(1) for c in axes), F.lit(0))
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "removed").when(n > 0, "changed").otherwise("same")
    return j.select(F.coalesce("__a", "__b").alias(key), change.alias("change"), F.when(change == "changed", n).otherwise(0).alias("axes"))


def leak_free_split(cases: DataFrame, text: str, stratum: str, forced: Column, share: float, seed: str) -> DataFrame:
    """Adds ``part``: whole groups of equal text go to ``train`` or ``valid``; groups with a forced row to ``train``.

    The draw ranks each stratum's groups by a seeded hash of the text, so it does not depend on row order. A
    group's stratum is its smallest. Groups are moved by that hash, which stands for the text; ranks are counts of a stratum's
    slices by leading digits of the hash, and only the slice that the border falls into is ranked row by row. Null texts are
    one group, the last.
    """
    groups = cases.withColumn("__h", F.sha2(F.concat(F.lit(seed), F.lower(F.trim(text))), 256))
    free = groups.groupBy("__h").agg(F.min(stratum).alias("__s"), F.max(forced).alias("__f")).filter(~F.col("__f"))
    free = kept(free.select("__h", "__s", F.coalesce(F.substring("__h", 1, SLICE_DIGITS), F.lit("~")).alias("__b")))
    slices = free.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__s")  # a row a slice
    before = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due = F.floor(F.sum("__n").over(w) * share)
    slices = slices.select(F.col("__s").alias("__s2"), F.col("__b").alias("__b2"), "__n", before.alias("__before"), due.alias("__due")).filter("__before < __due")
    drawn = free.filter("__h is not null").join(slices, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__b") == F.col("__b2")))
    whole, border = drawn.filter("__before + __n <= __due"), drawn.filter("__before + __n > __due")
    rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h"))
    border = border.withColumn("__r", rank).filter("__before + __r <= __due")
    valid = whole.select("__h").unionByName(border.select("__h")).withColumn("__v", F.lit(True))
    part = F.when(F.col("__v"), "valid").otherwise("train")
    return groups.join(valid, "__h", "left").withColumn("part", part).drop("__h", "__v")


def state_hash(df: DataFrame, name: str) -> DataFrame:
    """Table, n, hash of a frame, whatever its row order: the sum of 48-bit row hashes of canonical JSON, exact in a decimal."""
    columns = sorted(df.columns)
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.select(row.alias("h")).agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").alias("hash"))


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame and not the other, with the side, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


#: Each axis a case may assert, and the boundary it serves.
AXES = (
    ("note", "routage"), ("kind", "routage"), ("owner", "R1e"), ("recurring", "R2e/R3e"), ("event_date", "R2d"), ("language", "X-LANG"),
    ("needs_review", "X-CONF"), ("rel", "P-FR"), ("proj", "R0"), ("facts_min", "X-ONE"), ("entity_expected", "P-PERS"), ("no_entity", "P-PERS"),
    ("entity_proposed", "P-CREATE"), ("type_proposal", "P-TYPE"), ("no_type_proposal", "P-TYPE"), ("fact_proposed", "F-QUEUE"), ("fact_asserted", "F-QUEUE"),
    ("resource_url", "RES"), ("resource_owner_type", "RES"), ("resource_comment", "RES"), ("forbidden_value", "interdit"), ("forbidden_predicate", "interdit"),
    ("obsoletes", "NEG-b"), ("no_obsolete", "NEG-c"), ("cancels", "NEG-d"), ("no_cancel", "NEG-d"), ("memories", "X-ONE"),
    ("renamed_to", "PER-b"), ("no_rename", "PER-b"), ("drop_guard", "perte"),
)
ANSWER = "entities array<struct<canonical_name string, facts array<struct<predicate string, value string>>>>, relations array<struct<source string>>"


def asserted_axes(cases: DataFrame) -> DataFrame:
    """A row a case (id, body: JSON) and axis whose key is present, null or not; a case that asserts nothing has no row."""
    boundary = F.create_map(*[F.lit(x) for pair in AXES for x in pair])
    axes = F.array_intersect(F.array(*[F.lit(a) for a, _ in AXES]), F.json_object_keys("body"))
    return cases.select("id", F.explode(axes).alias("axis")).withColumn("boundary", boundary[F.col("axis")])


def nested_facts(answers: DataFrame) -> DataFrame:
    """A row a fact of the entities in an answer (id, answer: JSON); entities without facts have none."""
    entity = answers.select("id", F.explode(F.from_json("answer", ANSWER)["entities"]).alias("e"))
    return entity.select("id", F.col("e.canonical_name").alias("entity"), F.explode("e.facts").alias("f")).select("id", "entity", "f.predicate", "f.value")


def durable_count(answer: Column) -> Column:
    """Facts of all entities and relations of an answer; absent or null lists count nothing."""
    parsed = F.from_json(answer, ANSWER)
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    facts = F.aggregate(F.coalesce(parsed["entities"], F.array()), F.lit(0).cast("long"), lambda n, e: n + size(e["facts"]))
    return facts + size(parsed["relations"])
