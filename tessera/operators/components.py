"""Connected components of a link table (F18): by aggregates and joins, a graph of fewer nodes a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import kept


def components(links: DataFrame) -> DataFrame:
    """node, family (the smallest node it is connected with) of every node in ``links`` (a, b); order and repeats of links do not matter.

    Every node points to the smallest among itself and its neighbours, pointers are followed to their ends, and the ends are
    the nodes of the next round.  An end has at least one node that points to it, so the nodes of every component halve at least
    and all rounds together are of the order of the first.  Pointers are minima merged before the shuffle, so a node with very many
    links is no group of its own; they double, so chains end in few steps, and only nodes that others point to take them.
    """
    edges = kept(links.select("a", "b").filter("a is not null and b is not null"))
    found = None
    while True:
        both = edges.union(edges.select("b", "a"))
        tops = kept(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("top")))
        inner = kept(tops.filter("node <> top").join(tops.select(F.col("top").alias("node")).distinct(), "node", "left_semi"))
        while True:  # what has no pointer here is an end
            ahead = inner.select(F.col("node").alias("top"), F.col("top").alias("further"))
            step = kept(inner.join(ahead, "top", "left").select("node", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")))
            inner = step.select("node", "top")
            if step.filter("moved").isEmpty():
                break
        ends = kept(tops.join(inner.select(F.col("node").alias("top"), F.col("top").alias("end")), "top", "left").select("node", "top", F.coalesce("end", "top").alias("end")))
        if found is None:
            found = ends.select("node", F.col("end").alias("family"))
        else:
            found = found.join(ends.select(F.col("node").alias("family"), "end"), "family", "left").select("node", F.coalesce("end", "family").alias("family"))
        # a link that a pointer came from joins nothing new
        one = edges.join(ends.select(F.col("node").alias("a"), "top", F.col("end").alias("x")), "a").filter("b <> top")
        two = one.join(ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b").filter("x <> y")
        edges = kept(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return found
