"""A seeded memory of any size: S12.

Members of themes become entities, facts, links within a theme, bridges between themes, and notes.  Every draw is a hash of a
seed, a purpose and a name, and dates count back from a given day, so the same input gives the same memory, however it is
partitioned; nothing is drawn from a generator with a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How long ago something may have been mentioned, predicates within a theme, a fact by type, and forms of notes.
DAYS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 120)
WITHIN = ("linked_to", "knows", "works_with", "part_of", "evokes")
FACTS = {"person": ("context", "met recently"), "place": ("kind", "place"), "project": ("status", "running"), "organization": ("sector", "tech"), "concept": ("category", "idea"), "animal": ("species", "dog")}
NOTES = ("Thought of {a} today, it brought back {b}.", "A good talk about {a} and {b}.", "Quick note: {a}, to look into with {b}.", "A good moment with {a}.", "An idea about {a}, maybe linked to {b}.")
TAU = 30.0
#: Numbered parts of a theme: only their sizes meet in one task.
PARTS = 64


def draw(seed: int, purpose: str, *names: Column) -> Column:
    """A whole number below 2 ** 32."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *names)), 1, 8), 16, 10).cast("long")


def picked(values: tuple, number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def placed(members: DataFrame, seed: int) -> DataFrame:
    """``members`` (theme, name, type) with size (of the theme) and place (0, 1, ... in a seeded order); a theme of any size is numbered in parts."""
    part = F.pmod(draw(seed, "part", F.col("theme"), F.col("name")), F.lit(PARTS))
    dealt = members.select("theme", "name", "type").distinct().withColumn("part", part)
    sizes = dealt.groupBy("theme", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("theme").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("theme", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("theme")).alias("size"))
    own = F.row_number().over(Window.partitionBy("theme", "part").orderBy(draw(seed, "order", F.col("theme"), F.col("name")), "name"))
    return dealt.withColumn("own", own).join(sizes, ["theme", "part"]).select("theme", "name", "type", "size", (F.col("before") + F.col("own") - 1).alias("place"))


def identity(theme: str, name: str) -> Column:
    return F.concat(F.lit("syn-"), F.substring(F.md5(F.concat_ws("|", theme, name)), 1, 12))


def entities(members: DataFrame, today: Column, seed: int) -> DataFrame:
    """id, theme, canonical_name, type, mention_count, persistence_value, summary, last_mentioned, memory_strength, status."""
    rows = members.select("theme", "name", "type").distinct()
    number = lambda purpose: draw(seed, purpose, F.col("theme"), F.col("name"))
    ago = picked(DAYS, number("days"))
    return rows.select(
        identity("theme", "name").alias("id"), "theme", F.col("name").alias("canonical_name"), "type",
        (1 + F.pmod(number("mentions"), F.lit(12))).alias("mention_count"), (2 + F.pmod(number("persistence"), F.lit(4))).alias("persistence_value"),
        F.concat("name", F.lit(" - "), "theme").alias("summary"), F.date_sub(today, ago).alias("last_mentioned"),
        F.round(F.exp(-ago / TAU), 4).alias("memory_strength"), F.lit("active").alias("status"),
    )


def facts(members: DataFrame, seed: int) -> DataFrame:
    """entity_id, predicate, value, confidence: one fact an entity, by its type; unknown types count as concepts."""
    rows = members.select("theme", "name", "type").distinct()
    known = F.create_map(*[F.lit(x) for k, (p, v) in FACTS.items() for x in (k, f"{p}|{v}")])
    pair = F.split(F.coalesce(known[F.col("type")], F.lit("|".join(FACTS["concept"]))), r"\|")
    confidence = F.round(0.6 + F.pmod(draw(seed, "fact", F.col("theme"), F.col("name")), F.lit(36)) / 100, 2)
    return rows.select(identity("theme", "name").alias("entity_id"), pair[0].alias("predicate"), pair[1].alias("value"), confidence.alias("confidence"))


def links(members: DataFrame, seed: int) -> DataFrame:
    """src, predicate, dst, confidence: every member to two others of its theme (to one where there is only one; none if it is alone)."""
    rows = placed(members, seed)
    number = lambda purpose, *more: draw(seed, purpose, F.col("theme"), F.col("name"), *more)
    one = 1 + F.pmod(number("first"), F.greatest(F.lit(1), F.col("size") - 1))
    two = 1 + F.pmod(number("second"), F.greatest(F.lit(1), F.col("size") - 2))
    steps = F.when(F.col("size") >= 3, F.array(one, F.when(two >= one, two + 1).otherwise(two))).when(F.col("size") == 2, F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))
    out = rows.withColumn("step", F.explode(steps)).withColumn("to", F.pmod(F.col("place") + F.col("step"), F.col("size")))
    ends = rows.select("theme", F.col("place").alias("to"), F.col("name").alias("other"))
    return out.join(ends, ["theme", "to"]).select(
        identity("theme", "name").alias("src"), picked(WITHIN, number("predicate", F.col("other"))).alias("predicate"), identity("theme", "other").alias("dst"),
        F.round(0.55 + F.pmod(number("weight", F.col("other")), F.lit(36)) / 100, 2).alias("confidence"),
    )


def bridges(members: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """The given links between themes (a_theme, a, b_theme, b, predicate) whose ends are both there."""
    here = members.select("theme", "name").distinct()
    found = pairs.join(here.toDF("a_theme", "a"), ["a_theme", "a"]).join(here.toDF("b_theme", "b"), ["b_theme", "b"])
    confidence = F.round(0.5 + F.pmod(draw(seed, "bridge", F.col("a"), F.col("b")), F.lit(31)) / 100, 2)
    return found.select(identity("a_theme", "a").alias("src"), "predicate", identity("b_theme", "b").alias("dst"), confidence.alias("confidence"))


def notes(members: DataFrame, numbers: DataFrame, today: Column, seed: int) -> DataFrame:
    """id, content, mentioned (names), last_reactivated_at, memory_strength: a note for each row of ``numbers`` (id, theme), about one to three members of its theme."""
    rows = placed(members, seed)
    sizes = rows.select("theme", "size").distinct()
    n = lambda purpose: draw(seed, purpose, F.col("id").cast("string"))
    start, count = F.pmod(n("start"), F.col("size")), F.least(1 + F.pmod(n("count"), F.lit(3)), F.col("size"))
    wanted = numbers.join(sizes, "theme").select("id", "theme", "size", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.pmod(start + i * (1 + F.pmod(n("stride"), F.greatest(F.lit(1), (F.col("size") - 1) / 2).cast("long"))), F.col("size")))).alias("at", "place"))
    named = wanted.join(rows.select("theme", "place", "name"), ["theme", "place"])
    told = named.groupBy("id", "theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("mentioned"))  # three names at most
    form, a = picked(NOTES, n("form")), F.get("mentioned", 0)
    b = F.coalesce(F.get("mentioned", 1), a)
    ago = picked(DAYS, n("ago"))
    content = F.replace(F.replace(form, F.lit("{a}"), a), F.lit("{b}"), b)
    return told.select("id", content.alias("content"), "mentioned", F.date_sub(today, ago).alias("last_reactivated_at"), F.round(F.exp(-ago / TAU), 4).alias("memory_strength"))
