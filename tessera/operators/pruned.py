"""Exact nearest neighbours that skip blocks of vectors too far away to matter: J19, W05, G09, V01, V06.

Angles between unit vectors are a metric.  Vectors are dealt to the cells of some pivots, a cell to rings of equal angle
from its pivot, a ring to blocks of bounded size.  From the angle between two pivots and the angles of two blocks' rings
follows the smallest angle that two of their vectors can have.  Each block of queries first meets the blocks of
smallest bound that hold k vectors; what these give the worst-off query is a threshold, and of the other blocks only
those are met whose bound can reach it.  Which pairs of blocks are met is decided on a row a pair of blocks; the rows of
the result do not depend on the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.knn import best_of_block, matrix
from tessera.scratch import kept

BLOCK = 32768
#: Pivots of a dimension, from a sample of so many vectors at most: all that the driver ever holds. And rings of a half-circle.
PIVOTS, SAMPLE, RINGS = 64, 2048, 48
SLACK = 1e-4


@dataclass
class Found:
    """``hits``: q, id, sim, and rank where k is given.  ``pairs``: dim, qb, vb, round: the pairs of blocks, met in round 1 or 2, or skipped (0)."""

    hits: DataFrame
    pairs: DataFrame

    def skipped(self) -> float:
        """The share of pairs of blocks that were not met."""
        r = self.pairs.agg(F.count_if(F.col("round") == 0).alias("z"), F.count("*").alias("n")).first()
        return r["z"] / r["n"] if r["n"] else 0.0


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, up to PIVOTS unit vectors: centres of a seeded sample of at most SAMPLE vectors, moved three times to the mean of their cells."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    sample = vectors.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE).select("dim", "embedding").toPandas()
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim", "kind").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}
    out = {}
    for dim, g in sample.groupby("dim"):
        most = min(PIVOTS, 4 * -(-sizes[dim] // BLOCK))  # no more cells than blocks make sense of
        x = np.stack(g["embedding"].to_list()).astype(np.float64)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            continue
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = x[:1]
        while len(centres) < min(most, len(x)):  # the vector farthest from all centres is the next
            centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
        for _ in range(3):
            own = (x @ centres.T).argmax(axis=1)
            moved = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
            size = np.linalg.norm(moved, axis=1, keepdims=True)
            centres = np.where(size > 0, moved / np.where(size > 0, size, 1), centres)
        out[int(dim)] = centres
    return out


def celled(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell and angle; a vector that is no unit vector is in cell -1, about which nothing is known."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, angle = np.full(len(f), -1, np.int32), np.zeros(len(f))
            for dim, at in f.groupby("dim").indices.items():
                if int(dim) in centres:
                    x = np.stack(f["embedding"].iloc[at].to_list()).astype(np.float64)
                    sims = x @ centres[int(dim)].T
                    unit = np.abs(np.linalg.norm(x, axis=1) - 1) < 1e-5
                    cell[at] = np.where(unit, sims.argmax(axis=1), -1)
                    angle[at] = np.where(unit, np.arccos(np.clip(sims.max(axis=1), -1, 1)), 0)
            yield f.assign(cell=cell, angle=angle)

    return rows.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, cell int, angle double")


def blocked(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, a block of about BLOCK vectors of one dimension, kind and cell; cells of more than BLOCK are cut into rings first."""
    large = rows.groupBy("dim", "kind", "cell").agg((F.count("*") > BLOCK).alias("large"))  # a row a cell
    ringed = rows.join(large, ["dim", "kind", "cell"]).withColumn("ring", F.when(F.col("large"), F.floor(F.col("angle") / np.pi * RINGS)).otherwise(0).cast("int")).drop("large")
    sizes = ringed.groupBy("dim", "kind", "cell", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return ringed.join(sizes, ["dim", "kind", "cell", "ring"]).withColumn(name, F.xxhash64("dim", "kind", "cell", "ring", F.pmod(F.xxhash64("id"), "parts"))).drop("parts", "ring")


def block_rows(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("dim", "kind", name).agg(F.first("cell").alias("cell"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))


def bounds(queries: DataFrame, vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """dim, qb, vb, n, most: for each pair of blocks of one dimension, the size of the second and the largest cosine that two of their vectors can have."""
    a = block_rows(queries, "qb").select("dim", "kind", "qb", F.col("cell").alias("qc"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    b = block_rows(vectors, "vb").select("dim", "kind", "vb", F.col("cell").alias("vc"), F.col("lo").alias("vlo"), F.col("hi").alias("vhi"), "n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between = {d: np.arccos(np.clip(c @ c.T, -1, 1)) for d, c in centres.items()}
        for f in frames:
            apart = np.zeros(len(f))
            for dim, at in f.groupby("dim").indices.items():
                g = f.iloc[at]
                if int(dim) in between:
                    t = between[int(dim)][g["qc"].clip(lower=0), g["vc"].clip(lower=0)]
                    least = np.maximum.reduce([t - g["qhi"] - g["vhi"], g["qlo"] - t - g["vhi"], g["vlo"] - t - g["qhi"], np.zeros(len(g))])
                    apart[at] = np.where((g["qc"] < 0) | (g["vc"] < 0), 0, np.maximum(least - SLACK, 0))
            most = np.where((f["qc"] < 0) | (f["vc"] < 0), np.inf, np.cos(apart) + SLACK)  # of vectors that are not unit ones nothing is known
            yield f[["dim", "qb", "vb", "n"]].assign(most=most)

    return a.join(b, ["dim", "kind"]).mapInPandas(run, "dim int, qb long, vb long, n long, most double")


def meet(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int | None, floor: float, digits: int) -> DataFrame:
    """q, qb, id, sim: of each pair of blocks the k best of every query (None: all from the floor on)."""
    left = queries.select("qb", "id", "embedding").join(pairs.select("qb", "vb"), "qb")
    right = vectors.select("vb", "id", "embedding").join(pairs.select("qb", "vb"), "vb")

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "qb": [], "id": [], "sim": []}).astype({"q": "int64", "qb": "int64", "id": "int64"})
        b = b.sort_values("id")
        q, ids = a["id"].to_numpy(), b["id"].to_numpy()
        i, found, sim = best_of_block(q, matrix(a["embedding"]), ids, matrix(b["embedding"]), ids, k, floor, digits)
        return pd.DataFrame({"q": q[i], "qb": key[0], "id": found, "sim": sim})

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(best, "q long, qb long, id long, sim double")


def pruned_knn(queries: DataFrame, vectors: DataFrame, k: int | None, floor: float = -1.0, same_type: bool = False, digits: int = 6) -> Found:
    """The k vectors of highest cosine for each query (None: all from the floor on), ties to the smaller id; a query never finds its own id.

    Both frames: id, embedding, type.  Null and empty vectors take no part; vectors of different dimensions never meet.  Of
    vectors that are not unit ones inner products are compared, and none of their blocks is skipped.
    """
    usable = F.expr("embedding is not null and size(embedding) > 0" + (" and type is not null" if same_type else ""))
    kind = F.col("type") if same_type else F.lit(0)  # blocks hold one kind
    ready = lambda df: df.filter(usable).select("id", "embedding", kind.alias("kind"), F.size("embedding").alias("dim"))
    centres = pivots(ready(vectors))
    left = kept(blocked(celled(ready(queries), centres), "qb"))
    right = kept(blocked(celled(ready(vectors), centres), "vb"))
    pairs = kept(bounds(left, right, centres))
    run = lambda p: meet(p, left, right, k, floor, digits)
    reach = 10.0**-digits
    if k is None:
        pairs = pairs.withColumn("round", F.when(F.col("most") + reach >= floor, 1).otherwise(0))
        found = run(pairs.filter("round = 1"))
    else:
        nearest = Window.partitionBy("qb").orderBy(F.desc("most"), "vb")
        before = F.coalesce(F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pairs = kept(pairs.withColumn("first", before < k + 1))
        first = kept(run(pairs.filter("first")))
        ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).filter(F.col("r") == k).select("q", "sim")
        # a query with fewer than k so far can use anything from the floor on
        worst = left.select("qb", F.col("id").alias("q")).join(ranked, "q", "left").groupBy("qb").agg(F.min(F.coalesce("sim", F.lit(-np.inf))).alias("worst"))
        pairs = pairs.join(worst, "qb").withColumn("round", F.when(F.col("first"), 1).when(F.col("most") + reach >= F.greatest(F.col("worst"), F.lit(floor)), 2).otherwise(0))
        pairs = kept(pairs.select("dim", "qb", "vb", "round"))
        found = first.unionByName(run(pairs.filter("round = 2")))
    hits = found.select("q", "id", "sim")
    if k is not None:
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
        hits = hits.withColumn("rank", order).filter(F.col("rank") <= k)
    return Found(hits, pairs.select("dim", "qb", "vb", "round"))
