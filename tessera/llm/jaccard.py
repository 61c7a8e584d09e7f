"""Operator 9: exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance (1 - similarity) is a metric; two sets link at distance EPS or less.

1.  Equal sets become one node (a 128-bit digest of the sorted set, of which 64 bits name the node).
2.  Most nodes have no partner.  Every node shows its shingles below a hash threshold that depends on its
    size only; a partner shares all but EPS of the set, so a node that misses more than that many of them in
    all other nodes together is out.  What is left ("candidates") is a share of the corpus, and only their whole
    sets are formed.  The same test is repeated on whole sets.
3.  Recursion over the candidates.  A level draws pivots by a seeded hash (a quarter of its nodes at most), and finds their exact distances to
    all that lie within 3 EPS (a join on the pivots' rarest shingles, as many as no such pair can miss; all
    other distances are known to be larger).  Pivots within 2 EPS of another are ordinary nodes again.  Nodes within 2 EPS of a pivot leave for the Voronoi cell of
    their nearest one.  By the triangle inequality a partner of a member of cell p lies within 3 EPS of p, and one
    in another cell q is at most 2 EPS farther from p than from q, so these windows are replicated into
    region p, of two cells into the one with the smaller name only.  Nodes with no pivot that near
    are the remainder: the next level draws GROWTH times as many pivots from it, until all of it are pivots.
    Large groups are met by few pivots at early levels; what late levels hold is sparse.
4.  Regions of more than BLOCK members are split by pivots of their own in the same way (distances to a few
    pivots, nearest cells, windows of 2 EPS), as long as that at least halves them.  Members known to be
    connected need not meet: a region keeps, of its largest class, only what the distances to its pivot
    allow to be near the others.
5.  Small regions, and those that windows do not split, end in exact comparison, in blocks of bounded size,
    two blocks once at most, however many regions they share; a block pair gives a spanning forest.
6.  Components of the links give every document's class.

Edge cases: text that is null, empty or without words has no shingles and links with nothing; fewer words
than a shingle make one shingle; repeated rows and equal texts are one node; null ids take part, and the
smallest id that is there names the class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, null_safe, row_sum, table, whole_row
from .components import components

WORDS = 4
PERCENT = 85
PIVOTS, GROWTH, REGION_PIVOTS = 32, 16, 4
#: No level but the last makes more than this share of its nodes pivots.
MOST_PIVOTS = 0.25
POSTINGS_A_TASK = 4096
BLOCK, ROWS_A_TASK, COLUMNS = 512, 2000, 4096
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def rolled(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the windows of k word hashes."""
    n = max(0, len(a) - k + 1)
    h = a[:n] * MIX[0] + np.uint64(k)
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * MIX[1] + a[i : n + i]
    h = (h ^ (h >> np.uint64(32))) * MIX[2]
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles. Every distinct word of the batch is hashed once."""
    parts = [(t or "").encode().lower().split() for t in texts.to_pylist()]  # of bytes: A-Z only, and the six ASCII blanks
    ends = np.cumsum([0, *map(len, parts)])
    coded = pa.array([w for p in parts for w in p], pa.large_binary()).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashed = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    whole, out = rolled(hashed, words), []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        out.append(np.unique(whole[lo : hi - words + 1] if hi - lo >= words else rolled(hashed[lo:hi], int(hi - lo)) if hi > lo else whole[:0]))
    return out


def share_shown(n: int) -> float:
    """The share of hash space below which a set of n shingles shows them. Falls with n; above what a partner may lack."""
    return 1.0 if n <= 64 else 0.4 if n <= 256 else 0.3 if n <= 1024 else 0.22


def below(h: np.ndarray, share: float) -> int:
    return len(h) if share >= 1 else int(np.searchsorted(h, np.uint64(int(share * 2**64))))


def prefix(n: int, percent: int) -> int:
    """As many shingles of n, in any common order, hold one of every partner's as many."""
    return n + (percent * n) // -100 + 1


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def show(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row_sum, n, node, need, keys: the shown shingles; a node with partners shares ``need`` of the first ``low`` of them."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            shown = []
            for h in shingle_sets(b.column("text"), words):
                n = len(h)
                low = below(h, share_shown(100 * n // percent + 1))
                keys = h[: max(below(h, share_shown(n)), prefix(n, percent))].view(np.int64)
                node = np.uint64(xxhash.xxh3_128_intdigest(h.tobytes()) & (2**64 - 1)).view(np.int64) if n else None
                shown.append(keys)
                for column, v in zip(out, (n, node, low - (100 - percent) * n // 100, low), strict=True):
                    column.append(v)
            names = ["doc_id", "row_sum", "n", "node", "need", "low", "keys"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_sum"), *(pa.array(c, pa.int64()) for c in out), lists_of(shown)], names)

    rows = docs.select("doc_id", "text", row_sum(docs).alias("row_sum"))
    return arrow_batches(rows).mapInArrow(run, f"doc_id {id_type}, row_sum long, n long, node long, need long, low long, keys array<long>")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, n, shingles of every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [h for h in shingle_sets(b.column("text"), words) if len(h)]
            nodes = [np.uint64(xxhash.xxh3_128_intdigest(h.tobytes()) & (2**64 - 1)).view(np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), lists_of(sets)], ["node", "n", "shingles"])

    return arrow_batches(docs.select("text")).mapInArrow(run, "node long, n long, shingles array<long>")


def candidates(shown: DataFrame) -> DataFrame:
    """node, doc_id (one that has it): the nodes that share enough shown shingles with other nodes."""
    rows = shown.filter("n > 0").select("node", F.posexplode("keys").alias("pos", "key"), "low").select("node", "key", (F.col("pos") < F.col("low")).alias("low"))
    key = Window.partitionBy("key")
    by_node = key.orderBy("node")
    rows = rows.withColumns({"first": F.min("node").over(key), "last": F.max("node").over(key), "before": F.lag("node").over(by_node)})
    shared = rows.filter("first < last and (before is null or before <> node)")
    counts = shared.groupBy("node").agg(F.count_if("low").alias("shared"))
    nodes = shown.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("need").alias("need"))
    return nodes.join(counts, "node").filter("shared >= need").select("node", "doc_id")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, key, df, near: of each node that shares enough, the rarest shingles that others have, as many as a node within 3 EPS
    cannot miss (``near``: within EPS). Shingles nobody shares come first in that order, but join nothing, so they are only counted."""
    rows = sets.select("node", "n", F.explode("shingles").alias("key"))
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "key")
    ranked = shared.groupBy("node", "n").agg(F.count("*").alias("shared"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order"))  # one document's shingles
    ranked = ranked.filter(f"n - shared <= {100 - percent} * n div 100")
    upto = lambda pct: F.greatest(F.lit(0), F.expr(f"cast(n - ceil({pct} * n / 100) + 1 - (n - shared) as int)"))
    ranked = ranked.select("node", "n", upto(percent).alias("close"), F.slice("order", F.lit(1), upto(3 * percent - 200)).alias("order"))
    return ranked.select("node", "n", "close", F.posexplode("order").alias("pos", "x")).select("node", "n", F.col("x.key").alias("key"), F.col("x.df").alias("df"), (F.col("pos") < F.col("close")).alias("near"))


def with_distance(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (p, x, maybe more) with their distance d and ``link``."""
    one = sets.select(F.col("node").alias("p"), F.col("shingles").alias("sp"))
    two = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    met = pairs.join(one, "p").join(two, "x").withColumn("i", F.size(F.array_intersect("sp", "sx")).cast("long"))
    met = met.withColumn("u", F.size("sp") + F.size("sx") - F.col("i"))
    return met.select(*pairs.columns, (1 - F.col("i") / F.col("u")).alias("d"), (100 * F.col("i") >= percent * F.col("u")).alias("link"))


def near_labels(links: DataFrame) -> DataFrame:
    """node, label: some node that links connect it with; of the members of a pivot, and of pivots that share members, mostly one."""
    ways = links.select("p", "x").union(links.select("p", F.col("p").alias("x")))
    for _ in range(2):
        least = ways.groupBy("x").agg(F.min("p").alias("to"))
        ways = ways.join(least, "x").groupBy("p").agg(F.min("to").alias("hub")).join(ways, "p").select(F.col("hub").alias("p"), "x")
    return ways.groupBy(F.col("x").alias("node")).agg(F.min("p").alias("label"))


def chance(seed: str | int) -> Column:
    """A number in [0, 1) for each node, seeded."""
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def prefix_pairs(pivots: DataFrame, rows: DataFrame, percent: int, near: bool) -> DataFrame:
    """p, x: nodes of two parts of the index that share one of the rarest shingles, as all within 3 EPS do (``near``: EPS, and p < x).
    Frequent shingles are split over tasks."""
    parts = F.ceil(F.col("df") / POSTINGS_A_TASK)
    one = pivots.select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("node").alias("p"), F.col("n").alias("pn"), F.col("near").alias("pnear"))
    two = rows.select("key", F.pmod(F.xxhash64("node"), parts).alias("part"), F.col("node").alias("x"), F.col("n").alias("xn"), F.col("near").alias("xnear"))
    both = one.join(two, ["key", "part"]).filter("p < x and pnear and xnear" if near else "p <> x")
    return both.filter(100 * F.least("pn", "xn") >= (percent if near else 3 * percent - 200) * F.greatest("pn", "xn")).select("p", "x").distinct()


def sparse_pivots(index: DataFrame, sets: DataFrame, level: int, share: float, percent: int, scratch: Scratch) -> DataFrame:
    """node: the pivots of a level. Of those drawn that are within 2 EPS of each other the smaller name stays, so that a dense group has few."""
    drawn = index.filter(chance(level) < share)
    close = with_distance(prefix_pairs(drawn, drawn, percent, False).filter("p < x"), sets, percent).filter(F.col("d") <= (100 - percent) / 50 + 1e-9)
    return scratch.keep(drawn.select("node").distinct().join(close.select(F.col("x").alias("node")), "node", "left_anti"), f"pivots{level}")


def cells(met: DataFrame, within: float, window: float, eps: float) -> DataFrame:
    """region, p, node, d: the Voronoi cells of each region's pivots with their windows, from ``met`` (region, p, x, d, no pivots among x).

    ``within``: radius of a cell; ``window``: of the distances from p to nodes without a cell that are partners at most.
    """
    nearest = F.min(F.struct("d", "p")).over(Window.partitionBy("region", "x"))
    found = met.withColumn("c", nearest).withColumn("has", F.col("c.d") <= within)
    own = F.col("has") & (F.col("p") == F.col("c.p"))
    other = F.col("has") & (F.col("p") < F.col("c.p")) & (F.col("d") <= F.col("c.d") + 2 * eps + 1e-9)
    loose = ~F.col("has") & (F.col("d") <= window)
    return found.filter(own | other | loose).select("region", "p", F.col("x").alias("node"), "d")


def split_root(index: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links found, regions as tables of region, node, d): all links between candidates are found, or have both ends in a region."""
    eps, links, regions = (100 - percent) / 100, [], []
    here, level = index, 0
    while n := here.select("node").distinct().count():
        if n <= PIVOTS or level and n <= PIVOTS * GROWTH**level:  # all are pivots: all meet
            links.append(scratch.keep(with_distance(prefix_pairs(here, here, percent, True), sets, percent).filter("link").select("p", "x"), "last"))
            break
        pivots = sparse_pivots(here, sets, level, min(MOST_PIVOTS, PIVOTS * GROWTH**level / n), percent, scratch)
        others = here.join(pivots, "node", "left_anti")
        near = with_distance(prefix_pairs(here.join(pivots, "node", "left_semi"), others, percent, False), sets, percent)
        met = scratch.keep(near.filter(F.col("d") <= 3 * eps + 1e-9), f"met{level}")
        links.append(met.filter("link").select("p", "x"))
        found = cells(met.withColumn("region", F.lit(0).cast("long")), 2 * eps + 1e-9, 3 * eps + 1e-9, eps)
        regions.append(scratch.keep(found.select(F.xxhash64("p", F.lit(level)).alias("region"), "node", "d"), f"regions{level}"))
        gone = met.filter(F.col("d") <= 2 * eps + 1e-9).select(F.col("x").alias("node")).distinct()
        here = scratch.keep(others.join(gone, "node", "left_anti"), f"left{level}")
        level += 1
    return links, regions


def undecided(rows: DataFrame, label: DataFrame, eps: float) -> DataFrame:
    """region, node, d, label: the members that must still meet members of other classes.

    Members of a region's largest class meet only others: those nearer to the region's pivot than all others less
    EPS, or farther than all others and EPS, cannot be partners of any.
    """
    named = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = named.groupBy("region", "label").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    top = per.groupBy("region").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes")).filter("classes > 1").select("region", F.col("top.label").alias("most"))
    rest = per.join(top, "region").filter("label <> most").groupBy("region", "most").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return named.join(rest, "region").filter((F.col("label") != F.col("most")) | F.col("d").between(F.col("lo") - eps - 1e-9, F.col("hi") + eps + 1e-9)).select("region", "node", "d", "label")


def split_regions(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links found, regions to be compared exactly: region, node, d), by recursion into the regions of more than BLOCK members."""
    eps, links, done, level = (100 - percent) / 100, [], [], 0
    rows = rows.withColumn("parent", F.lit(1 << 60))
    while True:
        size = rows.groupBy("region").agg(F.count("*").alias("c"), F.first("parent").alias("parent"))
        deep = scratch.keep(size.filter((F.col("c") > BLOCK) & (2 * F.col("c") <= F.col("parent"))).select("region", "c"), f"deep{level}")
        done.append(rows.join(deep, "region", "left_anti").select("region", "node", "d"))
        if deep.isEmpty():
            return links, done
        # a region as large is split over tasks; its pivots go to each of them
        parts = F.ceil(F.col("c") / POSTINGS_A_TASK)
        sized = rows.join(deep, "region").select("region", "node", "d", "c", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part"), (chance(f"split{level}") < REGION_PIVOTS / F.col("c")).alias("is_pivot"))
        sized = scratch.keep(sized, f"sized{level}")
        pivots = sized.filter("is_pivot").select("region", F.col("node").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        pairs = sized.select("region", "part", F.col("node").alias("x"), "is_pivot", "c").join(pivots, ["region", "part"]).filter("p <> x and (not is_pivot or p < x)")
        met = scratch.keep(with_distance(pairs.select("region", "p", "x", "is_pivot", "c"), sets, percent), f"met-deep{level}")
        links.append(met.filter("link").select("p", "x"))
        found = cells(met.filter("not is_pivot"), 1.0, 0.0, eps)
        # by chance a region may draw no pivot: it is compared as it is
        done.append(sized.join(met.select("region").distinct(), "region", "left_anti").select("region", "node", "d"))
        rows = found.join(deep, "region").select(F.xxhash64("region", "p", F.lit(f"split{level}")).alias("region"), "node", "d", F.col("c").alias("parent"))
        rows, level = scratch.keep(rows, f"split{level}"), level + 1


def linked_in_blocks(x: list[np.ndarray], y: list[np.ndarray] | None, apart: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of sets of ``x`` and ``y`` (None: of ``x`` and ``x``) that link and are ``apart``, as few as connect what all connect.

    Intersections are a product of 0/1 matrices over the shingles that two sets share at least, some thousand
    columns at a time.
    """
    sets = x + (y or [])
    sizes = np.array([len(v) for v in sets])
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    fits = shared[column]
    owner, column = owner[fits], number[column[fits]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, cols = slice(0, len(x)), slice(len(x), None) if y is not None else slice(0, len(x))
    both = np.zeros((len(x), len(y) if y is not None else len(x)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        both += m[rows] @ m[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - both
    hit = (100 * both.astype(np.int64) >= percent * union.astype(np.int64)) & apart
    if y is None:
        hit = np.triu(hit, 1)
    top = list(range(len(sets)))

    def root(v: int) -> int:
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    out, shift = [], len(x) if y is not None else 0
    for i, j in zip(*np.nonzero(hit), strict=True):
        r, t = root(int(i)), root(int(j) + shift)
        if r != t:
            top[r] = t
            out.append((int(i), int(j)))
    return out


def meet_in_blocks(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: the links among rows that still have to meet.

    Each node has one home, the largest of its regions, cut into blocks of bounded size; two blocks meet once if
    any region has members of both, so a pair of nodes is compared once however many regions it shares.  A class
    with many members at home has blocks of its own, which need not meet each other.
    """
    sized = rest.join(rest.groupBy("region").agg(F.count("*").alias("c")), "region")
    home = sized.groupBy("node", "label").agg(F.max(F.struct("c", "region")).alias("h")).select("node", "label", "h.*")
    home = home.join(home.groupBy("region", "label").agg(F.count("*").alias("k")), ["region", "label"])
    many, place = F.col("k") >= BLOCK, F.xxhash64("node")
    block = F.when(many, F.xxhash64("region", "label", F.pmod(place, F.ceil(F.col("k") / BLOCK)))).otherwise(F.xxhash64("region", F.pmod(place, F.ceil(F.col("c") / BLOCK))))
    members = scratch.keep(home.select("node", "label", block.alias("block"), F.when(many, F.col("label")).alias("of")), "members")
    spots = rest.select("region", "node").join(members.select("node", "block", "of"), "node").select("region", "block", "of").distinct()
    x, y = spots.select("region", F.col("block").alias("x"), F.col("of").alias("xof")), spots.select("region", F.col("block").alias("y"), F.col("of").alias("yof"))
    meets = x.join(y, "region").filter("x <= y and coalesce(xof <> yof, true)").select("x", "y").distinct()
    left = meets.join(members.withColumnRenamed("block", "x"), "x").select("x", "y", "node", "label", F.lit(0).alias("side"))
    right = meets.filter("x < y").join(members.withColumnRenamed("block", "y"), "y").select("x", "y", "node", "label", F.lit(1).alias("side"))
    placed = scratch.keep(left.unionByName(right), "placed")
    tasks = -(-placed.count() // ROWS_A_TASK) or 1
    whole = placed.withColumn("task", F.pmod(F.xxhash64("x", "y"), F.lit(tasks))).join(sets.select("node", "shingles"), "node")

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, pair in g.groupby(["x", "y"], sort=False):
            a, b = pair[pair["side"] == 0], pair[pair["side"] == 1]
            other = b if len(b) else a
            apart = a["label"].to_numpy()[:, None] != other["label"].to_numpy()[None, :]
            if apart.any():
                found = linked_in_blocks(a["shingles"].to_list(), b["shingles"].to_list() if len(b) else None, apart, percent)
                one, two = a["node"].to_list(), other["node"].to_list()
                out += [(one[i], two[j]) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return whole.groupBy("task").applyInPandas(meet, "a long, b long")


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def classes(index: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, label: of all nodes with links the smallest node that links connect them with."""
    eps = (100 - percent) / 100
    links, regions = split_root(index, sets, percent, scratch)
    if regions:
        label = scratch.keep(near_labels(all_of(links)), "near")
        rest = scratch.keep(undecided(all_of(regions), label, eps), "open")
        if not rest.isEmpty():
            deeper, parts = split_regions(rest.drop("label"), sets, percent, scratch)
            if deeper:
                links += deeper
                label = scratch.keep(near_labels(all_of(links)), "near-deep")
                rest = scratch.keep(undecided(all_of(parts), label, eps), "rest")
            links.append(scratch.keep(meet_in_blocks(rest, sets, percent, scratch), "blocks").toDF("p", "x"))
    if not links:
        return scratch.keep(index.select("node", F.col("node").alias("label")).limit(0), "all")
    return scratch.keep(components(all_of(links).toDF("a", "b"), scratch, "all"), "all")


def labelled(docs: DataFrame, scratch: Scratch, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(shown: a row a document; node, label of every node)."""
    if percent < 67:
        raise ValueError("similarities below 67 percent are not supported: distances of 3 EPS must be below 1")
    shown = scratch.keep(show(docs, words, percent), "shown")
    nodes = scratch.keep(candidates(shown), "candidates")
    # texts meet the candidates' ids by a shuffle at every size: the ids are a share of the corpus, nothing to broadcast
    some = docs.select(null_safe(F.col("doc_id")).alias("__id"), "text").hint("merge").join(nodes.select(null_safe(F.col("doc_id")).alias("__id")).distinct(), "__id", "left_semi")
    sets = scratch.keep(whole_sets(some, words).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    label = classes(scratch.keep(rarest(sets, percent), "index"), sets, percent, scratch)
    scratch.drop_others("shown", "all")
    every = shown.filter("n > 0").select("node").distinct().join(label, "node", "left")
    return shown, every.withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``. percent: 67 at least."""
    shown, label = labelled(docs, scratch, words, percent)
    names = scratch.keep(shown.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(label, "node"), "names")
    named = names.join(names.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    out = shown.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near copies: one row of each class, that with the smallest id (null last; of equal ids that with the smallest
    checksum of the whole row; of equal rows any). Rows without words are in no class: all stay."""
    shown, label = labelled(docs, scratch, words, percent)
    row = shown.filter("n > 0").groupBy("node", "doc_id", "row_sum").agg(F.count("*").alias("equal"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_sum", "equal"))
    stay = row.join(label, "node").groupBy("label").agg(first.alias("s")).select("s.doc_id", "s.row_sum", "s.equal")
    none = shown.filter("n = 0").select("doc_id", "row_sum", F.lit(1).cast("long").alias("equal")).distinct()
    stay = scratch.keep(stay.unionByName(none).select(null_safe(F.col("doc_id")).alias("id"), "row_sum", "equal"), "stay")
    keyed = docs.select(whole_row(docs).alias("row"), null_safe(F.col("doc_id")).alias("id"), row_sum(docs).alias("row_sum"))
    kept = keyed.join(stay, ["id", "row_sum"])
    repeats = kept.filter("equal > 1").dropDuplicates(["id", "row_sum"])
    return kept.filter("equal = 1").unionByName(repeats).select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS s
  FROM w),
e AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(unnest(s)) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM s JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, s.s
"""
