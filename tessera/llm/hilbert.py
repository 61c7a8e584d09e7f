"""Operator 6: sharding along a Hilbert curve.

Several metadata columns are quantised to ``2 ** BITS`` equal-depth cells each, every row gets the index of
its cell on the Hilbert curve, rows are sorted by it, and the order is cut into runs of equal row counts
(law ``rows``).  A run then covers a compact region of the metadata space, so min/max statistics of the
shard's files prune on every one of the dimensions at once.

Scale: one range-partitioned sort of narrow rows (no text).  The tie-break inside a cell is a hash of the id
and the text's checksum, so a cell that holds a third of all rows is split by range partitioning like any
other.  Positions are partition offsets (one row a partition) plus the place within the partition.

Rows with equal texts have no place of their own to be together: the curve is that of the metadata, so copies
with other languages or sources lie elsewhere.

Edge cases: null text has size 1 and checksum 0; null metadata is the lowest cell; null ids tie and are
ordered by checksum; equal rows keep adjacent slots; an empty table gives no rows; a table with fewer rows
than shards leaves some shards empty; extra columns are carried by ``hilbert_positions`` callers' choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, repeated, row_sum, table, whole_row

SHARDS = 8
BITS = 4


def string_borders(df: DataFrame, name: str, bits: int) -> list[str]:
    """Equal-depth borders of a string column: the values that follow a share of i / 2 ** bits of the rows, from counts a value in
    value order. Running sums are partition offsets and sums inside a partition, so values are sorted over all tasks."""
    counts = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")).orderBy(F.col("v").asc_nulls_first())
    counts = counts.withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    parts = counts.groupBy("part").agg(F.sum("n").alias("k"))  # a row a partition
    parts = parts.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"), F.sum("k").over(whole).alias("all"))
    ranked = counts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), "part").withColumn("at", F.col("offset") + F.col("inner")).drop("inner")
    share = lambda c: F.floor(c * 2**bits / F.col("all"))
    crossed = ranked.filter(share(F.col("at")) < share(F.col("at") + F.col("n")))
    return sorted(r["v"] for r in crossed.select("v").collect() if r["v"] is not None)  # 2 ** bits values at most


def cut_points(df: DataFrame, dims: list[str], bits: int) -> list[list]:
    """Equal-depth borders of each dimension: 2 ** bits numbers or strings at most, whatever the table's size."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    text = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in text]
    row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(d) for d in numbers]).first() if numbers else {}
    return [string_borders(df, d, bits) if d in text else sorted(set(row[d] or [])) for d in dims]


def cell(key: Column, borders: list) -> Column:
    """How many borders lie at or below a number, or below a string."""
    out = F.lit(0)
    for b in borders:
        out = out + F.when(key > F.lit(b) if isinstance(b, str) else key >= F.lit(b), 1).otherwise(0)
    return out


def curve_index(df: DataFrame, coords: list[str], bits: int, out: str) -> DataFrame:
    """Adds the Hilbert index of integer coordinates below 2 ** bits, by bit operations on columns (Skilling, 2004)."""
    x = [f"__x{i}" for i in range(len(coords))]
    df = df.withColumns({a: F.col(c).cast("long") for a, c in zip(x, coords, strict=True)})
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i, a in enumerate(x):
            hit, first, own = F.col(a).bitwiseAND(q) != 0, F.col(x[0]), F.col(a)
            swap = first.bitwiseXOR(own).bitwiseAND(p)
            if i == 0:
                df = df.withColumn(a, F.when(hit, first.bitwiseXOR(F.lit(p))).otherwise(first))
            else:
                df = df.withColumns({x[0]: F.when(hit, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap)), a: F.when(hit, own).otherwise(own.bitwiseXOR(swap))})
        q >>= 1
    for a, b in zip(x[1:], x, strict=False):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(b)))
    turn, q = F.lit(0).cast("long"), 1 << (bits - 1)
    while q > 1:
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        q >>= 1
    df = df.withColumn("__turn", turn)
    df = df.withColumns({a: F.col(a).bitwiseXOR(F.col("__turn")) for a in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index * 2 + F.shiftright(F.col(a), b).bitwiseAND(F.lit(1))
    return df.withColumn(out, index).drop("__turn", *x)


def hilbert_positions(df: DataFrame, dims: list[str], ties: list[str], scratch: Scratch, bits: int = BITS) -> DataFrame:
    """``df`` (narrow) with ``curve`` and ``position``: 0, 1, 2, ... along the curve, ties by a hash of the first of ``ties``, then in their order, so rows equal in it lie together."""
    borders = cut_points(df, dims, bits)
    key = lambda d: F.col(d) if isinstance(df.schema[d].dataType, T.StringType) else F.col(d).cast("double")
    cells = df.withColumns({f"__c{i}": cell(key(d), b) for i, (d, b) in enumerate(zip(dims, borders, strict=True))})
    curved = curve_index(cells, [f"__c{i}" for i in range(len(dims))], bits, "curve").drop(*[f"__c{i}" for i in range(len(dims))])
    placed = scratch.keep(curved.orderBy("curve", F.xxhash64(ties[0]), *[F.col(t).asc_nulls_first() for t in ties]).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumns({"__part": F.shiftright(F.col("__at"), 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = offsets.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__part").withColumn("position", F.col("__offset") + F.col("__row")).drop("__at", "__part", "__row", "__offset")  # a row a partition


def cut_runs(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds shard and slot: runs whose row counts differ by one at most."""
    shard = F.expr(f"position * {shards}L div {max(total, 1)}L")
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - start).withColumn("shard", F.col("shard").cast("int"))


def write_shards(df: DataFrame, dims: list[str], path: str, scratch: Scratch, shards: int = SHARDS) -> None:
    """Writes the rows of ``df`` to one folder a shard, in the order of the curve, so that files carry tight statistics.

    Rows are told apart by their checksum; equal rows lie side by side on the curve, so their places are one interval,
    and one of them is written for each place.  The folders' column is ``shard``, the place within is ``slot``; where ``df`` has
    such columns, ours have underscores before them.
    """
    keyed = df.select(whole_row(df).alias("row"), row_sum(df).alias("sum"))
    narrow = scratch.keep(keyed.select(*[F.col("row").getField(d).alias(f"d{i}") for i, d in enumerate(dims)], "sum"), "narrow")
    places = hilbert_positions(narrow, [f"d{i}" for i in range(len(dims))], ["sum"], scratch)
    spans = places.groupBy("sum").agg(F.min("position").alias("lo"), F.count("*").alias("times"))
    rows = repeated(keyed.dropDuplicates(["sum"]).join(spans, "sum"), "times", "number")
    rows = cut_runs(rows.withColumn("position", F.col("lo") + F.col("number")), narrow.count(), shards)
    names = []
    for name in ("shard", "slot"):
        while name in df.columns:
            name = f"_{name}"
        names.append(name)
    rows = rows.select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
    rows.repartitionByRange(4 * shards, *names).sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    scratch = Scratch(spark, "op6")
    narrow = scratch.keep(docs, "narrow")
    placed = hilbert_positions(narrow, ["lang", "source", "size"], ["text_crc32", "doc_id", "size"], scratch)
    out = cut_runs(placed, narrow.count(), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
