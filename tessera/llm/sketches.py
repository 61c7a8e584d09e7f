"""Operator 12: near duplicates by SetSketch registers.

1.  A document's shingles become REGISTERS register values.  Every shingle sends points of a Poisson process, seeded by its
    hash, to random registers; a register keeps the earliest, which is exponentially distributed with the set's size, as
    its place on a logarithmic scale of base BASE, truncated to 16 bits.  The register of a union is the larger one
    (``merged``), so sketches of parts make the sketch of the whole.
2.  Equal sets become one node (128-bit digest).  BANDS bands of ROWS registers name the buckets in which nodes
    meet.  Two sets of similarity 0.8 share a bucket but for odds of (1 - 0.8 ** ROWS) ** BANDS = 4e-9; unrelated ones
    (0.05) share one with odds of 1e-6.
3.  All nodes of a bucket meet its smallest one, the hub; the nodes of all of a hub's buckets are its region.  The likelihood of how many registers are larger, equal and
    smaller, given both sizes, has its maximum at the estimate of the similarity; pairs whose estimate is more than
    SLACK below the limit go, the others are confirmed on whole sets.
4.  What a region holds besides meets in blocks, exactly, where it is not connected yet; pairs are never listed.
5.  Components of the links give every document's class.

Edge cases: text that is null, empty or without words has no shingles and links with nothing; fewer words than a shingle
make one shingle; repeated rows and equal texts are one node; null ids take part, and the smallest id that is there
names the class; rows of one id are kept or not together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, null_safe, table
from .components import components
from .jaccard import lists_of, meet_in_blocks, near_labels, shingle_sets, with_distance

WORDS, PERCENT = 2, 80
BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Six deviations of an estimate from REGISTERS registers at 0.8.
SLACK = 6 * math.sqrt(0.8 * 0.2 / REGISTERS)
AT_ONCE = 1 << 18
GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def sketched(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS register values (unsigned 16 bits) for each set of 64-bit hashes; an empty set's are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sets):  # some sets at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        least = np.full((hi - lo) * REGISTERS, np.inf)
        mine = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        seed, at, k = np.concatenate(sets[lo:hi]), np.zeros(len(mine)), 1
        while len(mine):
            more = max(1, AT_ONCE // 4 // len(mine))  # points of each shingle in this round
            h = scrambled(seed[:, None] + np.arange(k, k + more, dtype=np.uint64) * GOLDEN)
            gaps = np.log1p(-((h >> np.uint64(20)).astype(np.float64) * 2.0**-44)) / -REGISTERS
            points = np.cumsum(np.concatenate([at[:, None], gaps], axis=1), axis=1)[:, 1:]
            spot = mine[:, None] * REGISTERS + ((h & np.uint64(0xFFFFF)) * np.uint64(REGISTERS) >> np.uint64(20)).astype(np.int64)
            np.minimum.at(least, spot.ravel(), points.ravel())
            at, k = points[:, -1], k + more
            stay = at < least.reshape(-1, REGISTERS).max(axis=1)[mine]  # a point beyond all registers of its set changes none, nor do those after it
            mine, seed, at = mine[stay], seed[stay], at[stay]
        some = np.isfinite(least)
        value = np.zeros(len(least))
        value[some] = np.clip(np.floor(1 - np.log(np.maximum(least[some], 1e-300) / RATE) / math.log(BASE)), 0, TOP)
        out[lo:hi] = value.reshape(-1, REGISTERS)
        lo = hi
    return out


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(one, two)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each sketch and band."""
    part = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * GOLDEN
    for i in range(ROWS):
        h = scrambled(h + part[:, :, i] + GOLDEN)
    return h.view(np.int64)


def estimated(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarity of most likelihood for sets of ``n`` and ``m`` elements, of whose registers so many are larger and smaller.

    A register of the first is larger with chance p(u - v j), smaller with p(v - u j), where u and v are the shares of the
    sizes and p(x) = -log_BASE(1 - x (BASE - 1) / BASE).  The likelihood is concave in j: its slope is bisected.
    """
    u, v = n / (n + m), m / (n + m)
    equal = REGISTERS - larger - smaller
    c = (BASE - 1) / BASE
    chance = lambda x: -np.log1p(-x * c) / math.log(BASE)
    steep = lambda x: c / ((1 - x * c) * math.log(BASE))
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = chance(x), chance(y)
        dp, dq = -v * steep(x), -u * steep(y)
        up = larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest (of the whole set), registers; the last two null where there are no words."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), words)
            rows = sketched(sets)
            digests = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
            registers = [r.tobytes() if len(h) else None for r, h in zip(rows, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n", "digest", "registers"])

    return arrow_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, n long, digest binary, registers binary")


def banded(nodes: DataFrame) -> DataFrame:
    """key, node: a row for each node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            registers = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(registers).ravel()), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "key long, node long")


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of the pairs (p, x) those whose estimate is at least ``least``."""
    one = nodes.select(F.col("node").alias("p"), F.col("n").alias("pn"), F.col("registers").alias("pr"))
    two = nodes.select(F.col("node").alias("x"), F.col("n").alias("xn"), F.col("registers").alias("xr"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r, s = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(-1, REGISTERS) for c in ("pr", "xr"))
            j = estimated((r > s).sum(axis=1), (r < s).sum(axis=1), b["pn"].to_numpy(float), b["xn"].to_numpy(float))
            yield b.loc[j >= least, ["p", "x"]]

    return pairs.join(one, "p").join(two, "x").select("p", "x", "pn", "xn", "pr", "xr").mapInPandas(run, "p long, x long")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the one of its class that stays) for every row of ``docs``."""
    rows = scratch.keep(sketches(docs, words), "sketches")
    # a digest's rows are alike: any of them stands for all; the number given to it stays, as the table is written
    of_digest = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = scratch.keep(of_digest.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = banded(nodes)
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").drop("last")
    # a hub's region: the nodes of all its buckets, once each; two nodes of one bucket are in one region
    met = bands.join(hubs, "key").filter("node <> hub").groupBy(F.col("hub").alias("p"), F.col("node").alias("x")).agg(F.lit(True).alias("met")).select("p", "x")
    met = scratch.keep(met, "met")
    close = scratch.keep(likely(met, nodes, percent / 100 - SLACK), "likely")
    # whole sets: of the nodes of likely pairs, and of those in a region of more than the hub and one
    several = met.groupBy("p").agg(F.count("*").alias("c")).filter("c > 1").select("p")
    rest = met.join(several, "p").select(F.col("p").alias("region"), F.col("x").alias("node"))
    some = close.select(F.col("p").alias("node")).union(close.select("x")).union(rest.select("node")).distinct()
    wanted = scratch.keep(nodes.join(some, "node").select("node", "digest", null_safe(F.col("least")).alias("id")), "wanted")
    texts = docs.select(null_safe(F.col("doc_id")).alias("id"), "text").hint("merge").join(wanted.select("id").distinct(), "id", "left_semi")
    sets = scratch.keep(whole_sets(texts, words).join(wanted.select("node", "digest"), "digest").dropDuplicates(["node"]).select("node", "n", "shingles"), "sets")
    links = scratch.keep(with_distance(close, sets, percent).filter("link").select("p", "x"), "links")
    # the hub has met all others of its region; these must meet where they are of several classes
    rest = scratch.keep(undecided(rest, scratch.keep(near_labels(links), "near")), "rest")
    if not rest.isEmpty():
        links = links.union(scratch.keep(meet_in_blocks(rest, sets, percent, scratch), "blocks").toDF("p", "x"))
    found = components(links.toDF("a", "b"), scratch, "all")
    found = scratch.keep(found, "all")
    scratch.drop_others("sketches", "nodes", "all")
    named = scratch.keep(nodes.select("node", "digest", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    ids = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("digest", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(ids, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def undecided(rest: DataFrame, found: DataFrame) -> DataFrame:
    """region, node, d, label of the regions whose nodes are of several classes (``found``: node, label); d is 0, as all of them may be near."""
    named = rest.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("region")
    return named.join(apart, "region").select("region", "node", F.lit(0.0).alias("d"), "label")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """digest, n, shingles of every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [h for h in shingle_sets(b.column("text"), words) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), lists_of(sets)], ["digest", "n", "shingles"])

    return arrow_batches(docs.select("text")).mapInArrow(run, "digest binary, n long, shingles array<long>")


def op12_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) END) AS s
  FROM w),
e AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5_number(unnest(s)) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, s.doc_id = min(reach.b) AS kept
FROM s JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, s.s
"""
