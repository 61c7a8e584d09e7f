"""Exact nearest neighbours by blocks: J19, V01-V03, V04, V06, V08, V09, G09, W05."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.scratch import kept, numbered

BLOCK = 16384
#: Blocks of the right side are smaller where that spreads the work, and so many inner products are held at once.
SMALL, GROUPS, CELLS = 2048, 64, 1 << 21


def best_of_block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, unit: np.ndarray, k: int | None, floor: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``q``, units and rounded inner products of each query's ``k`` best units (None: all) from ``floor`` on, its own id apart, ties to the smaller unit.

    ``unit`` ascends.  Queries are taken a slice at a time, so that what is held does not grow with the product of the blocks;
    only what can reach the floor and the k-th of its row is rounded and sorted.
    """
    units, starts = np.unique(unit, return_index=True)
    single, reach, out = len(units) == len(unit), 10.0**-digits, []
    order = np.argsort(ids, kind="stable")
    known = ids[order]
    odd = not (np.isfinite(x).all() and np.isfinite(y).all())
    step = max(1, CELLS // max(1, len(ids)))
    for s in range(0, len(q), step):
        sims = x[s : s + step] @ y.T
        if odd:
            sims[np.isnan(sims)] = -np.inf
        own, end = np.searchsorted(known, q[s : s + step], "left"), np.searchsorted(known, q[s : s + step], "right")
        while (own < end).any():
            r = np.flatnonzero(own < end)
            sims[r, order[own[r]]] = -np.inf
            own[r] += 1
        if not single:
            sims = np.maximum.reduceat(sims, starts, axis=1)
        i, j = np.nonzero(sims >= max(floor - reach, np.finfo(np.float64).min))
        if k is not None and k < len(units) and len(i) > 16 * k * len(sims):
            i, j = np.nonzero(sims >= np.maximum(np.partition(sims, len(units) - k, axis=1)[:, [len(units) - k]] - reach, max(floor - reach, np.finfo(np.float64).min)))
        sim = np.round(sims[i, j], digits)
        fit = sim >= floor
        i, j, sim = i[fit], j[fit], sim[fit]
        if k is not None:
            at = np.lexsort((j, -sim, i))
            i, j, sim = i[at], j[at], sim[at]
            place = np.arange(len(i)) - np.searchsorted(i, i, "left")
            i, j, sim = i[place < k], j[place < k], sim[place < k]
        out.append((i + s, units[j], sim))
    if not out:
        return np.empty(0, np.int64), units[:0], np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def matrix(c: pd.Series) -> np.ndarray:
    return np.stack(c.to_list()).astype(np.float64)


def block_knn(queries: DataFrame, vectors: DataFrame, k: int | None, floor: float = -1.0, same_type: bool = False, digits: int = 6, unit: str = "id", part: str | None = None) -> DataFrame:
    """q, id, sim, rank: the k vectors of highest cosine for each query (None: all that reach the floor), ties to the smaller id; a query never finds its own id.

    Both frames: id, embedding (unit vectors), type.  Vectors of another dimension are skipped; null and empty
    vectors take no part.  Both sides are dealt to blocks of bounded size (with ``same_type`` each type apart) and every
    pair of blocks is one group, so no side is broadcast and none is gathered whole.

    ``unit``: a column of ``vectors`` that is found in place of id, by the best of its vectors (chunks of a note); a unit lies
    in one block.  ``part``: a whole-number column without nulls, each value of which has k hits of its own; added to the result.
    """
    usable = F.expr("embedding is not null and size(embedding) > 0" + (" and type is not null" if same_type else ""))
    kind = F.col("type") if same_type else F.lit(0)  # vectors of different types then never meet
    own = [F.col(c).alias(c) for c in ("id", "embedding")]  # columns of its own, as both frames may come from one
    left = queries.filter(usable).select(*own, F.size("embedding").alias("dim"), kind.alias("kind"))
    section = F.col(part).cast("int") if part else F.lit(0)
    right = vectors.filter(usable).select("id", "embedding", F.size("embedding").alias("dim"), kind.alias("kind"), F.col(unit).alias("unit"), section.alias("part"))
    if same_type:  # a type is cut by its own size, as its vectors only meet each other
        sizes = kept(left.groupBy("dim", "kind").agg(F.count("*").alias("a")).join(right.groupBy("dim", "kind").agg(F.count("*").alias("b")), ["dim", "kind"]))
        rows = sizes.agg(F.sum("b")).first()[0] or 1
        cuts = sizes.withColumn("n_left", F.ceil(F.col("a") / BLOCK)).withColumn("spread", F.floor(GROUPS * F.col("b") / (rows * F.col("n_left"))))
        n_right = F.greatest(F.ceil(F.col("b") / BLOCK), F.least(F.ceil(F.col("b") / SMALL), "spread"))
        cuts = cuts.select("dim", "kind", "n_left", n_right.alias("n_right"))
        left, right = left.join(cuts, ["dim", "kind"]), right.join(cuts, ["dim", "kind"])
        n_left, n_right = F.col("n_left").cast("int"), F.col("n_right").cast("int")
    else:
        rows = right.count()
        blocks = -(-left.count() // BLOCK) or 1
        n_left, n_right = F.lit(blocks), F.lit(max(-(-rows // BLOCK), min(-(-rows // SMALL), GROUPS // blocks)) or 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = left.withColumn("lb", deal("id", n_left)).withColumn("rb", each(n_right)).drop("n_left", "n_right")
    right = right.withColumn("rb", deal("unit", n_right)).withColumn("lb", each(n_left)).drop("n_left", "n_right")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"part": pd.Series(dtype="int32"), "q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})]
        x, q = (matrix(a["embedding"]), a["id"].to_numpy()) if len(a) else (None, None)
        for number, g in b.sort_values("unit", kind="stable").groupby("part") if len(a) else ():
            i, found, sim = best_of_block(q, x, g["id"].to_numpy(), matrix(g["embedding"]), g["unit"].to_numpy(), k, floor, digits)
            out.append(pd.DataFrame({"part": np.int32(number), "q": q[i], "id": found, "sim": sim}))
        return pd.concat(out)

    keys = ("dim", "kind", "lb", "rb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "part int, q long, id long, sim double")
    order = Window.partitionBy("part", "q").orderBy(F.desc("sim"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (2**31 - 1 if k is None else k))
    return ranked.withColumnRenamed("part", part) if part else ranked.drop("part")


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (of every place the smallest it is connected with) after places ``i`` are linked with ``j``."""
    while True:
        a, b = root[i], root[j]
        new = a != b
        if not new.any():
            return root
        i, j = i[new], j[new]
        np.minimum.at(root, np.maximum(a, b)[new], np.minimum(a, b)[new])
        while (root[root] != root).any():
            root = root[root]


def met_parts(vectors: DataFrame, floor: float, digits: int, middle: bool) -> tuple[DataFrame, bool]:
    """Links as in ``linked_parts`` from one pass, and whether it was the whole job; with ``middle`` and many blocks it is not: they then meet only the middle block of their dimension."""
    placed = numbered(vectors, ["dim", "part", "id"], "place")
    rows = placed.count()
    size = min(BLOCK, max(SMALL, -(-rows // GROUPS)))
    whole = not middle or rows <= 3 * size
    dealt = placed.withColumn("block", F.floor((F.col("place") - 1) / size))
    bounds = kept(dealt.groupBy("dim", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi")))
    lower = bounds.toDF("dim", "lb", "lo", "lower_hi")
    upper = bounds.toDF("dim", "rb", "upper_lo", "hi")
    if whole:
        pairs = lower.join(upper, "dim").filter("lb <= rb and lo < hi")
    else:  # a part of more than half of the vectors has it
        at = bounds.groupBy("dim").agg(F.floor((F.min("block") + F.max("block")) / 2).alias("rb"))
        pairs = lower.join(upper.join(at, ["dim", "rb"]), "dim").filter("least(lo, upper_lo) < greatest(lower_hi, hi)")
    pairs = kept(pairs.select("dim", "lb", "rb"))

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        for one in (a["part"].iloc[:1], b["part"].iloc[:1]):  # what lies in the one part of the other block is linked with it
            if len(one) and (a["part"] == one.iloc[0]).all():
                b = b[b["part"] != one.iloc[0]]
            elif len(one) and (b["part"] == one.iloc[0]).all():
                a = a[a["part"] != one.iloc[0]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        x, y = matrix(a["embedding"]), matrix(b["embedding"])
        parts, at = np.unique(np.concatenate([a["part"].to_numpy(), b["part"].to_numpy()]), return_inverse=True)
        root, step = np.arange(len(parts)), max(1, CELLS // len(y))
        for s in range(0, len(x), step):
            sims = x[s : s + step] @ y.T
            i, j = np.nonzero(sims >= floor - 10.0**-digits)
            fit = np.round(sims[i, j], digits) >= floor
            root = joined(root, at[s + i[fit]], at[len(x) + j[fit]])
        own = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": parts[own], "b": parts[root[own]]})

    keys = ("dim", "lb", "rb")
    # columns of its own, as both sides come from one frame
    left, right = (dealt.withColumnRenamed("block", b).join(pairs, ["dim", b]).select(*(F.col(c).alias(c) for c in (*keys, "part", "embedding"))) for b in ("lb", "rb"))
    return kept(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(link, "a long, b long").distinct()), whole


def linked_parts(vectors: DataFrame, floor: float, digits: int = 6) -> DataFrame:
    """a, b: links that connect the same parts as all pairs of unit vectors of two parts whose rounded cosine reaches ``floor``.

    ``vectors``: id, part (a whole number), embedding; those that are null or empty take no part, others meet those of their dimension.
    Vectors lie in blocks of bounded size by part, and every two blocks meet once, but for those that are whole of one part.
    A pair of blocks gives at most a link for each of its parts, so what is shuffled does not grow with the pairs found.

    Where there are many blocks, all first meet one of them, and the parts that this connects count as one when the others meet: where
    links are many that leaves little to do, where they are few it stays quadratic.
    """
    usable = kept(vectors.filter("embedding is not null and size(embedding) > 0").select("id", "part", "embedding", F.size("embedding").alias("dim")))
    links, whole = met_parts(usable, floor, digits, middle=True)
    if whole:
        return links
    wider = components(links).select(F.col("node").alias("part"), F.col("family").alias("wider"))
    rest = usable.join(wider, "part", "left").select("id", F.coalesce("wider", "part").alias("part"), "embedding", "dim")
    return links.union(met_parts(rest, floor, digits, middle=False)[0])
