"""Operator 5: exact top-k search by no-random-access aggregation over sorted lists.

A query's score is the sum of LISTS partial scores, the inner products over groups of dimensions.  Each group
makes one list of a block's vectors, sorted by partial score.  The lists are read from the top, all to the same
depth, in doubling depths.  A vector that was met in some list has a lower bound (its unread parts at the far
end of their lists) and an upper bound (its unread parts at their lists' frontiers); a vector met in none can
reach the sum of the frontiers at most.  Reading stops when that sum is below the k-th lower bound, so that no
outsider can qualify; the few met vectors whose upper bound reaches the k-th lower bound get their final scores.
Few lists with many dimensions each close early: a sum of few parts that is high has high parts.

Bounds are floating-point with a slack for rounding that grows with the numbers; final scores are whole-number
arithmetic, whatever the components' size.

Scale: vectors and queries are dealt to blocks of bounded size; every query block meets every vector block,
each pair is one group; k rows a query and block go on to a final ranking.  No vector set is broadcast.  A vector
is shuffled once for every QUERIES_A_BLOCK queries, a query once for every VECTORS_A_BLOCK vectors.

Edge cases: vectors null, or with null or non-finite components, and rows with a null id take no part; a
query meets vectors of its own dimension only (empty vectors have score 0 with each other); components and scores
beyond 64 bits are cut to the largest or smallest long, so that they tie; equal scores rank by smaller id;
repeated ids: rows with the query's id are its own and are left out, and every query row gets its own result;
fewer candidates than k give fewer rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K = 5
LISTS = 2
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8192, 4096
FIRST_DEPTH = 128  # the first depth is a list's length through this
QUERIES_AT_ONCE = 32
LONG = np.iinfo(np.int64)


def read_lists(lists: np.ndarray, own: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, int]:
    """No-random-access reading for one query: (places of the vectors that may be among its k best, depth read).

    ``lists``: a row a list, a column a vector; ``own``: vectors that take no part; ``slack``: above the rounding error of a sum.
    """
    n = lists.shape[1]
    far_end = lists.min(axis=1)[:, None]
    depth = max(k + 1, n // FIRST_DEPTH)
    while True:
        depth = min(depth, n)
        top = np.argpartition(lists, n - depth, axis=1)[:, n - depth :]
        frontier = np.take_along_axis(lists, top, axis=1).min(axis=1)[:, None]
        met = np.unique(top)
        met = met[~own[met]]
        part = lists[:, met]
        read = part >= frontier
        low = np.where(read, part, far_end).sum(axis=0)
        kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        needed = np.clip(kth - slack, LONG.min, LONG.max)
        if depth == n or np.clip(frontier.sum() + slack, LONG.min, LONG.max) < needed:
            high = np.where(read, part, frontier).sum(axis=0)
            return met[np.clip(high + slack, LONG.min, LONG.max) >= needed], depth
        depth *= 2


def final_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond 64 bits the nearest long."""
    if float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * len(q) < 2.0**62:
        return x @ q
    return np.array([min(max(int(s), LONG.min), LONG.max) for s in x.astype(object) @ q.astype(object)], np.int64)


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query of a block: (its place, ids and scores of the k best vectors of a block, depth read)."""
    real, wide, out = x.astype(float), np.abs(x.astype(float)).max(axis=0, initial=0), []
    groups = np.array_split(np.arange(x.shape[1]), LISTS)
    for at in range(0, len(q), QUERIES_AT_ONCE):
        some = q[at : at + QUERIES_AT_ONCE].astype(float)
        partial = np.stack([some[:, g] @ real[:, g].T for g in groups])
        slack = (len(wide) + 4) * 2.0**-51 * (np.abs(some) @ wide)
        for i in range(len(some)):
            rows, depth = read_lists(partial[:, i], ids == q_ids[at + i], k, float(slack[i]))
            scores = final_scores(x[rows], q[at + i])
            best = np.lexsort((ids[rows], ~scores))[:k]  # ~s falls as s grows, at the ends of long too
            out.append((at + i, ids[rows[best]], scores[best], depth))
    return out


def search(vectors: DataFrame, scratch: Scratch, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: vec_id long, v array<long>; ``is_query``: a condition on vec_id."""
    rows = scratch.keep(vectors.filter("vec_id is not null").select("vec_id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, q_blocks = -(-size["n"] // VECTORS_A_BLOCK) or 1, -(-size["q"] // QUERIES_A_BLOCK) or 1
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.filter(is_query).withColumn("qb", dealt(q_blocks)).withColumn("vb", every(n_blocks))
    right = rows.withColumn("vb", dealt(n_blocks)).withColumn("qb", every(q_blocks))

    def top(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, x = np.stack(queries["v"].to_list()), np.stack(block["v"].to_list())
        q_ids, rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
        found = block_top(q_ids, q, block["vec_id"].to_numpy(), x, k)
        parts = [pd.DataFrame({"row": rows[i], "query_id": q_ids[i], "vec_id": ids, "score": scores}) for i, ids, scores, _ in found]
        return pd.concat(parts)

    best = left.groupBy("d", "qb", "vb").cogroup(right.groupBy("d", "qb", "vb")).applyInPandas(top, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(256 x); rows with a null or non-finite component go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    usable = F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))
    return embeddings.filter(usable).select("vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(whole_vectors(table(spark, sf_dir, "embeddings")), Scratch(spark, "op5"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
