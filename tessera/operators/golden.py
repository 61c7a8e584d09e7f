"""States of related tables made comparable whatever their ids, times and row order: E15, E16, H05."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tessera.scratch import numbered


@dataclass
class Table:
    """How a table is normalised.

    ``key``: its id column, replaced by ``prefix`` and a number; None: it has none.  ``order``: its natural key, columns of its own
    or references (then the referred row's number counts).  ``refs``: column -> table it refers to (itself included).
    ``moments``: columns kept only as there or not.  ``sets``: array columns whose order means nothing.
    """

    key: str | None = None
    prefix: str = "U"
    order: list[str] = field(default_factory=list)
    refs: dict[str, str] = field(default_factory=dict)
    moments: list[str] = field(default_factory=list)
    sets: list[str] = field(default_factory=list)


def in_order(spec: dict[str, Table]) -> list[str]:
    """The tables, those referred to before those that refer to them; a reference to itself is none."""
    done: list[str] = []
    while len(done) < len(spec):
        ready = [n for n, t in spec.items() if n not in done and all(r in done or r == n for r in t.refs.values())]
        if not ready:
            raise ValueError(f"references run in a circle: {sorted(set(spec) - set(done))}")
        done += ready
    return done


def normalised(tables: dict[str, DataFrame], spec: dict[str, Table]) -> dict[str, DataFrame]:
    """The tables with ids as tokens, moments as presence, floating-point numbers as decimals of six places.

    Tokens are numbers in the order of natural keys, handed along references: a child is sorted by its parent's number, so
    no random id decides anything.  Rows of one natural key are told apart by all their other columns; rows equal in
    all of them are interchangeable.  A reference to a row that is not there becomes null.
    """
    out, tokens = {}, {}
    for name in in_order(spec):
        t, df = spec[name], tables[name]
        for c in t.moments:
            df = df.withColumn(c, F.col(c).isNotNull())
        for c in t.sets:
            df = df.withColumn(c, F.array_sort(c))
        for f in df.schema.fields:
            if isinstance(f.dataType, DoubleType | FloatType):
                df = df.withColumn(f.name, F.col(f.name).cast("double").cast("decimal(38,6)"))
            elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, DoubleType | FloatType):
                df = df.withColumn(f.name, F.col(f.name).cast("array<double>").cast("array<decimal(38,6)>"))
        later = [c for c, to in t.refs.items() if to == name]
        for c, to in t.refs.items():
            if to != name:
                df = referred(df, c, tokens[to])
        ids = {t.key, *later}
        rest = [c for c in df.columns if c not in ids and c not in t.order and not c.startswith("__")]
        order = [f"__{c}" if c in t.refs and c not in later else c for c in [*t.order, *rest]]
        if t.key:
            df = numbered(df, order, "__number")
            tokens[name] = df.select(F.col(t.key).alias("__id"), F.col("__number"), F.concat(F.lit(t.prefix), F.col("__number").cast("string")).alias("__token"))
            for c in later:
                df = referred(df, c, tokens[name])
            df = df.withColumn(t.key, F.concat(F.lit(t.prefix), F.col("__number").cast("string")))
        out[name] = df.select(*tables[name].columns)
    return out


def referred(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """``column`` replaced by the token of the row it refers to; ``__column`` is that row's number."""
    found = tokens.select(F.col("__id").alias("__to"), F.col("__number").alias(f"__{column}"), F.col("__token").alias("__t"))
    return df.drop(f"__{column}").join(found, df[column] == found["__to"], "left").withColumn(column, F.col("__t")).drop("__to", "__t")


def rows(state: dict[str, DataFrame]) -> DataFrame:
    """table, row (JSON with its columns by name, nulls shown)."""
    parts = [df.select(F.lit(n).alias("table"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")) for n, df in state.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def differences(a: dict[str, DataFrame], b: dict[str, DataFrame], most: int = 3) -> DataFrame:
    """Table, side, place, row: of each table and side the first ``most`` rows that the other state lacks, repeats counted; no row: the states agree."""
    signed = rows(a).withColumn("n", F.lit(1)).unionByName(rows(b).withColumn("n", F.lit(-1)))
    extra = signed.groupBy("table", "row").agg(F.sum("n").alias("n")).filter("n <> 0")  # one shuffle of each state's rows
    sides = extra.withColumn("side", F.when(F.col("n") > 0, "left").otherwise("right"))
    first = F.row_number().over(Window.partitionBy("table", "side").orderBy("row"))
    repeats = F.explode(F.sequence(F.lit(1), F.least(F.abs("n"), F.lit(most)).cast("int")))
    few = sides.withColumn("first", first).filter(F.col("first") <= most).withColumn("again", repeats)
    place = F.row_number().over(Window.partitionBy("table", "side").orderBy("row", "again"))
    return few.withColumn("place", place).filter(F.col("place") <= most).select("table", "side", "place", "row")


def fingerprint(state: dict[str, DataFrame]) -> DataFrame:
    """Table, n, hash of every table of a state: the sum of 48-bit hashes of its rows, exact in a decimal, whatever their order."""
    h = F.conv(F.substring(F.sha2("row", 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows(state).groupBy("table").agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").alias("hash"))
