"""Named passages in texts, found whole: C17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import kept

#: Passages of fewer words are found by runs of letters instead: as many as the largest power of two that they have, up to LETTERS.
WORDS, LETTERS = 5, 16


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def found_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, item_id of every text (id, text) that holds a passage (item_id, text), whatever the case. Null and empty passages are found nowhere.

    A text that holds a passage holds the words inside it as words, so both meet on a window of three of them (the first and
    last word may be part of longer ones).  Passages of fewer than WORDS words meet texts on a run of their letters; texts
    are cut into runs only for the lengths that such passages have.  Of its windows or runs a passage takes the one that
    the fewest passages have, so that many passages with a common start do not all meet the same texts.  Then the whole
    passage is looked for.
    """
    named = items.select("item_id", F.lower("text").alias("passage")).filter(F.length("passage") > 0)
    held = met_on_keys(docs, items).join(named, "item_id").join(docs.select("id", "text"), "id")
    return held.filter(F.lower("text").contains(F.col("passage"))).select("id", "item_id")


def met_on_keys(docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, item_id of every text and passage with a common key, a few more than those that hold one."""
    window = lambda w, i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    named = items.select("item_id", F.lower("text").alias("passage"), words(F.col("text")).alias("w")).filter(F.length("passage") > 0)
    inside = F.transform(F.sequence(F.lit(2), F.size("w") - 3), lambda i: window(F.col("w"), i))
    long = rarest(named.filter(F.size("w") >= WORDS).select("item_id", "passage", F.lit(0).alias("n"), inside.alias("keys")))
    rows = docs.select("id", "text", words(F.col("text")).alias("w"))
    last = F.size("w") - 2
    keys = rows.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.when(i <= last, window(F.col("w"), i))))).alias("key"))
    met = keys.join(long.select("item_id", "key"), "key").select("id", "item_id")
    short = named.filter(F.size("w") < WORDS).withColumn("n", F.pow(F.lit(2), F.floor(F.log2(F.least(F.length("passage"), F.lit(LETTERS))))).cast("int"))
    short = rarest(short.select("item_id", "passage", "n", runs_of(F.col("passage"), F.col("n")).alias("keys")))
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # powers of two up to LETTERS
        runs = docs.select("id", F.explode(runs_of(F.lower("text"), F.lit(n))).alias("key"))
        met = met.unionByName(runs.join(short.filter(F.col("n") == n).select("item_id", "key"), "key").select("id", "item_id"))
    return met.distinct()


def rarest(items: DataFrame) -> DataFrame:
    """item_id, n, key: of each passage's ``keys`` the one that the fewest passages with the same ``n`` have."""
    each = items.select("item_id", "passage", "n", F.explode(F.array_distinct("keys")).alias("key"))
    shared = each.groupBy("n", "key").agg(F.count("*").alias("many"))
    least = F.min(F.struct("many", "key"))["key"]
    return kept(each.join(shared, ["n", "key"]).groupBy("item_id", "passage", "n").agg(least.alias("key")).select("item_id", "n", "key"))


def runs_of(text: Column, n: Column) -> Column:
    """Hashes of the distinct runs of ``n`` letters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, n))))
