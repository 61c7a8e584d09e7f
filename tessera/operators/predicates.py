"""Families of predicates that say the same, and the name each family keeps: F18."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import predicate_signature
from tessera.operators.components import components
from tessera.operators.knn import linked_parts
from tessera.scratch import kept

#: Predicates that the memory can supersede; as names they go before all others.
HEADS = ("works_at", "job_title", "lives_in", "has_birthday", "phone", "email", "age")


def vocabulary(facts: DataFrame, *more: Column) -> DataFrame:
    """predicate, n (facts), entities (that have one) of ``facts`` (entity_id, predicate), and what ``more`` aggregates."""
    return facts.filter("predicate is not null").groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"), *more)


def keys(rows: DataFrame) -> DataFrame:
    """node, place, key of ``rows`` (node, predicate): what predicates that say the same share.

    The signature (place -1), and of predicates of three tokens or more, for every token, the others: who shares these differs in one.
    """
    split = rows.select("node", predicate_signature(F.col("predicate")).alias("signature"), F.split("predicate", "_").alias("t"))
    others = lambda k: F.concat_ws("_", F.slice("t", 1, k), F.lit("\x01"), F.slice("t", k + 2, F.size("t")))
    apart = F.transform("t", lambda x, k: F.struct(k.alias("place"), others(k).alias("key")))
    whole = F.array(F.struct(F.lit(-1).alias("place"), F.col("signature").alias("key")))
    return split.select("node", F.inline(F.when(F.size("t") >= 3, F.concat(whole, apart)).otherwise(whole))).filter("key is not null")


def stars(keyed: DataFrame) -> DataFrame:
    """a, b: every node with the smallest that has the same key. Not all pairs: a key of many predicates is as many links."""
    least = F.min("node").over(Window.partitionBy("place", "key"))
    return keyed.select(F.col("node").alias("a"), least.alias("b")).filter("a <> b")


def families(rows: DataFrame, near: DataFrame | None = None, vectors: DataFrame | None = None, floor: float = 1.0) -> DataFrame:
    """predicate, family, canonical, members: predicates connected by signature, by one token, by ``near`` (a, b: two of ``rows``), or by cosine.

    ``vectors``: predicate, embedding (unit vectors); two of them link their predicates from ``floor`` on.  They are the last to be
    looked at, and only where the other links have left two predicates apart, as those of one family would link nothing new.

    The canonical name is a head if the family has one (the first by name), else the predicate of most entities, then of most
    facts, then the first by name.  Predicates without a variant are families of one.
    """
    named = kept(rows.withColumn("node", F.monotonically_increasing_id()))  # links are whole numbers; names come back in the end
    links = stars(keys(named))
    if near is not None:
        node = lambda c: named.select(F.col("predicate").alias(c), F.col("node").alias(f"{c}_node"))
        links = links.union(near.select("a", "b").join(node("a"), "a").join(node("b"), "b").select("a_node", "b_node"))
    found = named.join(components(links), "node", "left").withColumn("family", F.coalesce("family", "node"))
    if vectors is not None:
        found = kept(found)
        held = vectors.select("predicate", "embedding").join(found.select("predicate", F.col("node").alias("id"), F.col("family").alias("part")), "predicate")
        met = components(linked_parts(held, floor)).select(F.col("node").alias("family"), F.col("family").alias("wider"))
        found = found.join(met, "family", "left").withColumn("family", F.coalesce("wider", "family"))
    found = kept(found.select("predicate", "n", "entities", "family"))
    rank = F.struct((~F.col("predicate").isin(*HEADS)).alias("other"), (-F.col("entities")).alias("e"), (-F.col("n")).alias("n"), "predicate")
    head = F.struct((~F.col("predicate").isin(*HEADS)).alias("other"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n"), "predicate")
    best = F.min(F.when(F.col("predicate").isin(*HEADS), head).otherwise(rank))
    chosen = kept(found.groupBy("family").agg(F.min("predicate").alias("name"), best["predicate"].alias("canonical"), F.count("*").alias("members")))
    return found.join(chosen, "family").select("predicate", F.col("name").alias("family"), "canonical", "members")


def renamed(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``facts`` with every predicate replaced by its family's canonical name."""
    names = chosen.select("predicate", "canonical")
    out = facts.join(names, "predicate", "left").withColumn("predicate", F.coalesce("canonical", "predicate"))
    return out.select(*facts.columns)
