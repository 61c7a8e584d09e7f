"""Pruned neighbours equal those of all blocks, and skip most of them on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, pruned
from tessera.operators.knn import block_knn
from tessera.sources import seed

VECTORS = "id long, embedding array<double>, type long"


def clustered(spark, groups, size, dim, spread, seed_):
    rng = np.random.default_rng(seed_)
    out = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(size):
            v = centre / np.linalg.norm(centre) + spread * rng.normal(size=dim) / dim**0.5
            out.append((len(out), (v / np.linalg.norm(v)).tolist(), len(out) % 3))
    odd = [(9000, None, 0), (9001, [], 0), (9002, [1.0, 0.0], 0), (9003, [0.0, 1.0], 0), (9004, out[3][1], 0), (9005, out[3][1], 1), (9006, [3.0 * x for x in out[5][1]], 2), (9007, [0.0] * dim, 0)]
    return spark.createDataFrame(out + odd, VECTORS)


def rows(df):
    return sorted((r["q"], r["rank"], r["id"], round(r["sim"], 6)) for r in df.select("q", "rank", "id", "sim").collect())


def pairs(df):
    return sorted((r["q"], r["id"], round(r["sim"], 6)) for r in df.select("q", "id", "sim").collect())


@pytest.mark.parametrize(("k", "floor", "same"), [(5, -1.0, False), (3, 0.9, True), (2000, 0.5, False), (None, 0.95, False)])
def test_equals_all_blocks(spark, monkeypatch, k, floor, same):
    monkeypatch.setattr(pruned, "BLOCK", 64)
    monkeypatch.setattr(pruned, "PIVOTS", 12)
    v = clustered(spark, 12, 60, 16, 0.3, 1)
    q = v.filter("id % 7 = 0 or id > 8999")
    want = block_knn(q, v, k, floor, same)
    found = pruned.pruned_knn(q, v, k, floor, same)
    if k is None:
        assert pairs(found.hits) == pairs(want)
    else:
        assert rows(found.hits) == rows(want)


def test_most_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK", 64)
    monkeypatch.setattr(pruned, "PIVOTS", 32)
    v = clustered(spark, 32, 60, 16, 0.2, 2).filter("id < 9000")
    found = pruned.pruned_knn(v.filter("id % 5 = 0"), v, 4)
    assert rows(found.hits) == rows(block_knn(v.filter("id % 5 = 0"), v, 4))
    assert found.skipped() > 0.8
    assert pruned.pruned_knn(v.limit(0), v, 4).hits.count() == 0 and pruned.pruned_knn(v.limit(3), v.limit(0), 4).hits.count() == 0


def test_seeded_memory(spark):
    members = spark.createDataFrame([(f"t{t}", f"m{t}-{i}", ["person", "place", "odd"][i % 3]) for t in range(5) for i in range(1 if t == 4 else 2 if t == 3 else 30)], "theme string, name string, type string")
    numbers = spark.range(200).select("id", F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("theme"))
    today = F.lit("2026-06-01").cast("date")

    def built(parts):
        m, n = members.repartition(parts), numbers.repartition(parts)
        return [sorted(map(str, df.collect())) for df in (seed.entities(m, today, 1), seed.facts(m, 1), seed.links(m, 1), seed.notes(m, n, today, 1))]

    one = built(1)
    assert one == built(8) and one != [sorted(map(str, df.collect())) for df in (seed.entities(members, today, 2), seed.facts(members, 2), seed.links(members, 2), seed.notes(members, numbers, today, 2))]
    links = seed.links(members, 1).collect()
    assert len(links) == 3 * 30 * 2 + 2 and all(r["src"] != r["dst"] for r in links) and len({(r["src"], r["dst"]) for r in links}) == len(links)
    theme = {r["id"]: r["theme"] for r in seed.entities(members, today, 1).collect()}
    assert all(theme[r["src"]] == theme[r["dst"]] for r in links)
    found = graph.louvain(sorted(theme), [(r["src"], r["dst"], r["confidence"]) for r in links])
    of = {c: {theme[i] for i in theme if found[i] == c} for c in set(found.values())}
    assert all(len(t) == 1 for t in of.values()) and len(of) >= 5  # no community mixes themes
    for r in seed.notes(members, numbers, today, 1).collect():
        assert 1 <= len(r["mentioned"]) == len(set(r["mentioned"])) <= 3 and {m.split("-")[0] for m in r["mentioned"]} == {f"m{r['id'] % 5}"}
    named = members.select("theme", F.col("name").alias("b"))
    far = named.filter("b = 'm1-3'").select(F.lit("t0").alias("a_theme"), F.lit("m0-0").alias("a"), F.col("theme").alias("b_theme"), "b", F.lit("p").alias("predicate"))
    assert seed.bridges(members, far, 1).count() == 1 and seed.bridges(members, far.withColumn("a", F.lit("nobody")), 1).count() == 0
