"""Columns of the caller's with the operators' own names, map columns, and very many equal rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, hilbert, jaccard, mixing, qda
from tessera.llm.common import Scratch, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
NAMES = ("__id", "__sum", "__source", "__size", "__place", "__times", "__copy", "__block", "__row", "__words", "__lines", "__held_out", "__epochs", "__last", "__lo", "__hi", "__equal",
         "id", "row", "row_sum", "sum", "key", "equal", "last", "epochs", "times", "copy", "place", "size", "number", "position", "shard", "slot", "curve", "lo", "hi", "label", "node", "n", "d0", "x", "p", "min", "h")


def clashing(spark):
    docs = table(spark, DATA, "documents").filter("doc_id < 60")
    return docs.withColumns({n: F.concat(F.lit(f"{n}="), F.col("doc_id").cast("string")) for n in NAMES})


def test_stages_leave_clashing_columns_alone(spark):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns, name
        rows = made.collect()
        assert rows and all(r[n] == f"{n}={r['doc_id']}" for r in rows for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_shards_with_clashing_and_map_columns(spark, tmp_path):
    docs = clashing(spark).select("doc_id", "lang", "__sum", "shard", "slot", "position", "d0", F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    one = docs.limit(1).select("doc_id", "lang", "__sum", "shard", "slot", "position", "d0", F.create_map(F.lit("k"), F.lit(-1).cast("long")).alias("m"))
    rows = docs.unionByName(one)  # differs from another row in its map alone
    hilbert.write_shards(rows, ["lang", "doc_id"], str(tmp_path / "out"), Scratch(spark, "t"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    plain = lambda df: Counter(str(r) for r in df.select(*rows.columns).collect())
    assert plain(back) == plain(rows) and {"_shard", "_slot"} <= set(back.columns)


def test_equal_rows_in_great_number(spark, tmp_path):
    n = 100_000
    same = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("some equal words").alias("text"), F.lit("s").alias("source"))
    other = spark.range(1000).select((F.col("id") + 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("t").alias("source"))
    rows = same.unionByName(other)
    plan = mixing.plan_mix(rows, Scratch(spark, "t"), cut_border=False).select(F.sum(F.col("epochs") + (F.col("extra") > 0).cast("long"))).first()[0]
    assert mixing.repeat_rows(rows, Scratch(spark, "t")).count() == plan
    hilbert.write_shards(rows, ["source"], str(tmp_path / "out"), Scratch(spark, "t"), 8)
    counts = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect()]
    assert sum(counts) == n + 1000 and max(counts) - min(counts) <= 1
    assert jaccard.keep_one(rows, Scratch(spark, "t")).filter("doc_id = 1").count() == 1


def test_repeated_in_parts(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 23), ("e", 10)], "k string, t long")
    got = Counter((r["k"], r["i"]) for r in common.repeated(rows, "t", "i", at_once=10).collect())
    assert got == Counter((k, i) for k, t in (("b", 1), ("c", 7), ("d", 23), ("e", 10)) for i in range(t))


def test_checksums_tell_maps_apart(spark):
    rows = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m")).union(spark.range(1).select(F.create_map(F.lit("b"), F.lit(1)).alias("m"))).union(spark.range(1).select(F.create_map(F.lit("a"), F.lit(None).cast("int")).alias("m")))
    assert rows.select(common.row_sum(rows)).distinct().count() == 3


def test_discriminant_against_numpy(spark):
    """The quality score once more: moments, shrinkage and densities in numpy from the collected features."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    features = qda.features(docs.withColumn("held", qda.held_out()), ["doc_id", "held"]).toPandas().set_index("doc_id")
    x = {i: r[list(qda.FEATURES)].to_numpy(float) for i, r in features.iterrows()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and not features.loc[r["doc_id"], "held"]}
    d, total = len(qda.FEATURES), len(known)
    scatter, stats = {}, {}
    for k in (0, 1):
        own = np.stack([x[i] for i, q in known.items() if q == k])
        stats[k] = (own.mean(axis=0), len(own))
        scatter[k] = (own - stats[k][0]).T @ (own - stats[k][0])
    pooled = (scatter[0] + scatter[1]) / total

    def density(k, v):
        mean, n = stats[k]
        own = (scatter[k] + d * pooled) / (n + d)
        cov = (1 - qda.TO_POOLED - qda.TO_ROUND) * own + qda.TO_POOLED * pooled + (qda.TO_ROUND * np.trace(own) / d + qda.FLOOR) * np.eye(d)
        sign, log_det = np.linalg.slogdet(cov)
        return np.log(n / total) - 0.5 * log_det - 0.5 * (v - mean) @ np.linalg.solve(cov, v - mean)

    for r in qda.score_documents(docs, labels, Scratch(spark, "t")).collect():
        odds = np.clip(density(1, x[r["doc_id"]]) - density(0, x[r["doc_id"]]), -40, 40)
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-6 and r["predicted"] == int(r["score"] >= qda.THRESHOLD)
