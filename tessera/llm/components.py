"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node reachable. ``links``: a, b. Nodes without links are left out.

    Alternates the two star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows.  Minima are aggregates (merged on the map side) joined back, so a node with very
    many links is no group of its own.  Each step writes its edges, so lost executors cost one step.
    """

    def star(edges: DataFrame, both: bool) -> DataFrame:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        spread = near.join(least, "a")
        if both:
            return spread.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return spread.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, mark, step = scratch.keep(edges, f"{name}-0"), None, 0
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark, step = (now["n"], now["h"]), step + 1
        edges = scratch.keep(star(star(edges, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
