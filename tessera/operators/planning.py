"""What is still to be written so that a corpus meets its targets: E18, A15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bare(text: Column) -> Column:
    """Letters and digits alone, in lower case: what two captures are compared by."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def fresh(candidates: DataFrame, corpus: DataFrame, text: str, order: str) -> DataFrame:
    """The candidates whose bare text is not in the corpus, of equal ones the first by ``order``. Null and bare-empty texts go."""
    keyed = candidates.withColumn("__bare", bare(F.col(text))).filter(F.length("__bare") > 0)
    key = F.sha2("__bare", 256)
    # one row a text by an aggregate, so that a text of very many copies is no group
    first = keyed.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*candidates.columns), order).alias("row"))
    known = corpus.select(F.sha2(bare(F.col(text)), 256).alias("__key")).distinct()
    return first.join(known, "__key", "left_anti").select("row.*")


def shares(counts: DataFrame, cells: list[str], targets: DataFrame, total: int) -> DataFrame:
    """cells, have, want (the cell's share of ``total``, rounded half up) and missing (never below 0), for each target cell, with or without captures yet."""
    have = targets.join(counts, cells, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    want = F.floor(F.col("share") * total + 0.5).cast("long")
    return have.select(*cells, "have", want.alias("want"), F.greatest(F.lit(0).cast("long"), want - F.col("have")).alias("missing"))


def apportioned(missing: DataFrame, cells: list[str], batch: int) -> DataFrame:
    """Adds ``quota``: ``batch`` (or all that is missing, if less) over the cells in proportion to what they lack, by largest remainders.

    Whole numbers only; ties of the remainder go to the cell that lacks more, then to the first by name.  No cell gets
    more than it lacks.  The windows hold a row a cell.
    """
    every = Window.partitionBy()
    n = F.least(F.lit(batch).cast("decimal(38,0)"), F.sum("missing").over(every).cast("decimal(38,0)"))
    part = missing.withColumn("__all", F.sum("missing").over(every)).withColumn("__n", n.cast("long"))
    exact = F.expr("cast(missing as decimal(19,0)) * cast(__n as decimal(19,0))")
    whole = F.when(F.col("__all") > 0, F.expr("cast(missing as decimal(19,0)) * cast(__n as decimal(19,0)) div __all")).otherwise(F.lit(0))
    part = part.withColumn("__whole", whole.cast("long")).withColumn("__rest", exact - F.col("__whole") * F.col("__all").cast("decimal(19,0)"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("__rest"), F.desc("missing"), *cells))
    left = F.col("__n") - F.sum("__whole").over(every)
    return part.withColumn("quota", F.col("__whole") + F.when((place <= left) & (F.col("missing") > 0), 1).otherwise(0)).drop("__all", "__n", "__whole", "__rest")


def language_share(have: int, of_language: int, target: float, total: int, batch: int) -> int:
    """How many of the next ``batch`` must be of a language for the finished corpus of ``total`` to hold a share ``target`` of it.

    It follows from what is missing, not from the target: of what remains to be written, as much as is still due.
    """
    due = max(0, round(target * total) - of_language)
    return round(batch * min(1.0, due / max(1, total - have)))
