"""Passages of all lengths in texts, as a plain search finds them."""

from tessera.operators.passages import found_passages

TEXTS = [(1, "The quick brown fox jumps over the lazy dog"), (2, "xthe quick brown fox jumpsy"), (3, "a b"), (4, None), (5, ""), (6, "dog"), (7, "Hot   DOGS are\nhere and the\tquick brown fox"), (8, "été: l'ÉTÉ indien arrive ici")]
PASSAGES = [(1, "the quick brown fox jumps"), (2, "QUICK"), (3, "og"), (4, "fox jumps over"), (5, ""), (6, None), (7, "x"), (8, "a b"), (9, "hot   dogs are\nhere"), (10, "over the lazy dog and more"), (11, "l'été indien arrive ici"), (12, " "), (13, "quick brown fox jumps ove")]


def test_as_a_plain_search(spark):
    docs, items = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(PASSAGES, "item_id long, text string")
    want = {(i, k) for i, t in TEXTS if t for k, p in PASSAGES if p and p.lower() in t.lower()}
    found = [(r["id"], r["item_id"]) for r in found_passages(docs, items).collect()]
    assert sorted(found) == sorted(want)
    assert found_passages(docs, items.limit(0)).count() == 0 and found_passages(docs.limit(0), items).count() == 0
