"""Families of predicates at size: links that connect parts, components by contraction, keys by place."""

import numpy as np

from tessera.operators import knn, predicates
from tessera.operators.components import components
from tessera.operators.knn import linked_parts


def roots(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_random_graphs(spark):
    r = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(90)]
    got = {r["node"]: r["family"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(links, {n for x in links for n in x})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_parts_connect_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 32)
    monkeypatch.setattr(knn, "SMALL", 16)
    monkeypatch.setattr(knn, "CELLS", 100)
    r = np.random.default_rng(3)
    for dims, floor in ((6, 0.9), (24, 0.62), (24, 0.95)):  # connected, partly connected, apart
        x = r.normal(size=(300, dims))
        x[::7, :] = x[0]  # copies
        x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 9)
        parts = [0 if i % 5 else 2 * i for i in range(300)]  # one holds most
        rows = [(i, parts[i], x[i].tolist()) for i in range(300)]
        odd = [(500, 9, None), (501, 9, []), (502, 11, [1.0, 0.0]), (503, 13, [1.0, 0.0]), (504, 15, [float("nan")] * dims)]
        got = linked_parts(spark.createDataFrame(rows + odd, "id long, part long, embedding array<double>"), floor).collect()
        hit = np.round(x @ x.T, 6) >= floor
        want = [(parts[i], parts[j]) for i, j in zip(*np.nonzero(hit), strict=True)] + [(11, 13)]
        nodes = {*parts, 9, 11, 13, 15}
        assert roots([(r["a"], r["b"]) for r in got], nodes) == roots(want, nodes)


def test_links_do_not_grow_with_pairs(spark):
    same = spark.range(600).selectExpr("id", "id AS part", "array(0.6D, 0.8D) AS embedding")
    assert linked_parts(same, 0.4).count() == 599  # of 179,700 pairs


def test_tokens_differ_in_one_place(spark):
    rows = [("x_\x01_z", 1, 1), ("\x01_y_z", 1, 1), ("p_q_r", 1, 1), ("p_s_r", 1, 1), ("one_two", 1, 1), ("one_six", 1, 1)]
    got = {r["predicate"]: r["family"] for r in predicates.families(spark.createDataFrame(rows, "predicate string, n long, entities long")).collect()}
    assert got == {"x_\x01_z": "x_\x01_z", "\x01_y_z": "\x01_y_z", "p_q_r": "p_q_r", "p_s_r": "p_q_r", "one_two": "one_two", "one_six": "one_six"}


def test_vectors_link_families(spark):
    rows = spark.createDataFrame([("b_c_d", 1, 1), ("b_c_e", 2, 1), ("lone", 3, 2), ("far", 1, 1), ("bare", 1, 1)], "predicate string, n long, entities long")
    vectors = spark.createDataFrame([("b_c_e", [1.0, 0.0]), ("lone", [0.6, 0.8]), ("far", [-1.0, 0.0])], "predicate string, embedding array<double>")
    got = {r["predicate"]: (r["family"], r["canonical"], r["members"]) for r in predicates.families(rows, vectors=vectors, floor=0.6).collect()}
    assert got == {**dict.fromkeys(["b_c_d", "b_c_e", "lone"], ("b_c_d", "lone", 3)), "far": ("far", "far", 1), "bare": ("bare", "bare", 1)}
