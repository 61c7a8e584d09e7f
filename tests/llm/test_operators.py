"""Each operator against a brute-force version on the smallest tables, and on messy, repeated and empty rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, hilbert, jaccard, mixing, outliers, packing, pii, qda, queries, tokencount, topk
from tessera.llm.common import Scratch, table

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the and of to in is that was for with as on be at by this had not are but from or have an they which one you were all her she there would their"
NEAR = " ".join(PROSE.split() * 4 + [f"word{i}" for i in range(80)])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n int, g string, label int, row long, node long"


def clash(i):
    return (7, f"k{i}", 3, "g", 1, 9, 9)


MESSY = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one", "en", "b", 3),
    (5, "one two three", "en", "b", 13),
    (6, NEAR, "en", "b", len(NEAR)),
    (7, NEAR + " tail", "en", "a", len(NEAR) + 5),
    (8, NEAR.upper(), "fr", None, len(NEAR)),
    (8, NEAR.upper(), "fr", None, len(NEAR)),
    (None, "no id at all but some words here", "de", "c", 30),
    (None, None, None, None, None),
    (9, "x " * 60_000 + "mail me.now@host.example.org or +1 (509) 555-6973", "en", "a", 120_050),
    (10, "a" * 50_000, "en", "c", 50_000),
    (11, "line one is here again\n" * 40, "en", "c", 900),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, *clash(i)) for i, r in enumerate(MESSY)], SCHEMA)


@pytest.fixture(scope="module")
def none(messy):
    return messy.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in table(spark, DATA, "documents").collect()]


def word_list(text):
    return WORDS.findall(text or "")


# --- 1: chat formatting


def talk(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, conv string")


def cheapest(roles):
    """The least cost of a repair, by trying all ways."""
    best = {chat.START: 0}
    for r in roles:
        after = {}
        for s, c in best.items():
            for t in range(3):
                cost = c + chat.option(r, s, t)[0]
                after[t] = min(after.get(t, cost), cost)
        best = after
    return min(c + chat.end_cost(s) for s, c in best.items())


def test_chat_is_legal_and_cheapest_however_it_is_cut(spark, monkeypatch):
    rng = np.random.default_rng(1)
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, roles[rng.integers(5)], f"t{t}") for c in range(6) for t in range(30 if c else 200)]
    results = []
    for size in (10_000, 12):
        monkeypatch.setattr(chat, "ROWS_A_PART", size)
        monkeypatch.setattr(chat, "FAN", 3 if size == 12 else 1000)
        found = chat.repair_roles(talk(spark, rows), Scratch(spark, "t")).orderBy("conv_id", "position").collect()
        assert [(r["conv_id"], r["turn"]) for r in found] == sorted((c, t) for c, t, *_ in rows)
        assert [r["position"] for r in found] == [r["turn"] for r in found]
        assert len(found) == len(rows)
        results.append({c: sum(r["cost"] for r in found if r["conv_id"] == c) for c in range(6)})
        for c in range(6):
            text = "".join(r["fragment"] for r in found if r["conv_id"] == c)
            turns = re.findall(r"<\|(\w+)\|>\n(?s:.*?)<\|end\|>\n", text)
            assert re.fullmatch("s?(ua)+", "".join(t[0] for t in turns))
            assert all(f"t{t}" in text for t in range(30))
    want = {c: cheapest([chat.known_role(r[2]) for r in rows if r[0] == c]) for c in range(6)}
    assert results == [want, want]


def test_chat_messy(spark):
    rows = [(None, None, None, None), (None, 1, "USER ", ""), (2, 1, "system", "x"), (2, 1, "system", "x"), (3, 5, "user", "q"), (3, 5, "user", "q")]
    found = chat.repair_roles(talk(spark, rows), Scratch(spark, "t"))
    places = [(r["conv_id"], r["position"]) for r in found.collect()]
    assert sorted(places, key=str) == sorted([(None, 0), (None, 1), (2, 0), (2, 1), (3, 0), (3, 1)], key=str)
    names = spark.createDataFrame([(None, 1, "user", "a"), ("null", 1, "user", "b")], "conv_id string, turn long, role string, text string")
    assert [r["position"] for r in chat.repair_roles(names, Scratch(spark, "t")).collect()] == [0, 0]
    assert found.count() == 6 and found.filter("fragment is null or out_role is null").count() == 0
    assert chat.repair_roles(talk(spark, rows).limit(0), Scratch(spark, "t")).count() == 0


# --- 2: mixing


def test_mix_water_filling(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "abcd"[min(3, i % 8)]) for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, Scratch(spark, "t")).toPandas()
    per = plan.groupby("skey").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(1.5 * plan["size"].sum()) and (per.target <= 2 * per["size"] + 1e-9).all()
    assert (abs(per.taken - per.target) <= 1).all() and (plan.taken <= 2 * plan["size"]).all()
    free = per[per.target < 2 * per["size"] - 1e-9]
    weight = {"va": 3, "vb": 1, "vc": 2, "vd": 3}
    assert len({round(t / weight[k], 6) for k, t in free.target.items()}) <= 1
    again = mixing.plan_mix(docs.repartition(7), Scratch(spark, "t")).toPandas()
    assert sorted(map(tuple, plan.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_mix_messy(spark, messy, none):
    plan = mixing.plan_mix(messy, Scratch(spark, "t")).toPandas()
    assert len(plan) == len(MESSY) and (plan.taken[plan["size"] == 0] == 0).all()
    rows = mixing.repeat_rows(messy, Scratch(spark, "t"))
    assert rows.columns == messy.columns and rows.filter("source is null and text = ' \\t\\n '").count() <= 2
    assert {r["doc_id"] for r in rows.collect()} <= {r[0] for r in MESSY}
    # null and equal ids, equal rows: every row as often as the plan takes its place
    odd = [(None, f"w{i} " * 20, "s") for i in range(60)] + [(5, f"v{i} " * 20, "s") for i in range(30)] + [(None, "same " * 20, "s")] * 30
    odd = spark.createDataFrame(odd, "doc_id long, text string, source string")
    assert mixing.repeat_rows(odd, Scratch(spark, "t")).count() == 180
    assert mixing.repeat_rows(odd.filter("text like 'same%'"), Scratch(spark, "t")).count() == 45
    assert mixing.plan_mix(none, Scratch(spark, "t")).count() == 0 == mixing.repeat_rows(none, Scratch(spark, "t")).count()


# --- 3: packing


def check_packing(found, capacity):
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= capacity


def test_pack_ids_and_places(spark, docs):
    from tokenizers import Tokenizer

    found = queries.QUERIES["op3_pack_documents"](spark, DATA).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text, _ in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, at // 4096): (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found.itertuples()} == want
    check_packing(found, 4096)
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 4096) + 1


def test_encoder_equals_library():
    import random

    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    ours, library, rng = packing.Encoder(file), Tokenizer.from_file(file), random.Random(5)
    letters = [*"aB é.,'s1Ⅷİß\ń\tΣ日!", "<|endoftext|>", "'ll", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids_of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_pairs_large_items_at_most_twice():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 101, 3000).tolist())
    plan = packing.plan_packing(counts, 100)
    bins = {}
    for length, lo, hi, first, offset in plan:
        for b in range(first, first + hi - lo):
            bins.setdefault(b, []).append((offset, length))
    assert Counter(x for b in bins.values() for _, x in b) == counts
    for b in bins.values():
        b.sort()
        assert sum(3 * x > 100 for _, x in b) <= 2
        assert [o for o, _ in b] == [sum(x for _, x in b[:i]) for i in range(len(b))] and sum(x for _, x in b) <= 100
    assert packing.plan_packing({}, 100).shape == (0, 5)


def test_pack_messy(spark, messy, none):
    file = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack_documents(messy, file, Scratch(spark, "t"), 64).toPandas()
    check_packing(found, 64)
    assert (found[found.doc_id.isin([1, 2, 3])].length == 1).all() and found.doc_id.isna().sum() >= 2
    assert packing.pack_documents(none, file, Scratch(spark, "t")).count() == 0


# --- 4: outliers


def repeated_words(w):
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})


def base_of(text):
    w, lines = word_list(text), [x for x in (text or "").split("\n") if WORDS.search(x)]
    r = repeated_words(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, len(w) < 10 or 100 * r > 20 * len(w)


def test_outlier_base_and_verdicts(spark, docs):
    found = {r["doc_id"]: tuple(r)[1:] for r in outliers.judge(table(spark, DATA, "documents"), ["doc_id"], Scratch(spark, "t")).collect()}
    assert {i: f[:6] for i, f in found.items()} == {i: base_of(t) for i, t, _ in docs}
    assert not any(f[6] for f in found.values() if f[5])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
    good = [found[i] for i, q in labels.items() if q == 1 and not found[i][5]]
    assert sum(f[6] for f in good) >= 0.97 * len(good)


def test_outlier_in_a_small_group_is_judged_by_the_next_level(spark):
    rng, vocabulary, rows = np.random.default_rng(5), [f"{x}{y}" for x in PROSE.split() for y in ("", "s", "ing", "ed")], []

    def add(lang, source, n, junk=""):
        for _ in range(n):
            w = rng.choice(vocabulary, int(rng.integers(60, 300)))
            rows.append((len(rows), "\n".join(" ".join(x) + junk for x in np.array_split(w, 6)), lang, source))
        return [r[0] for r in rows[-n:]]

    add("en", "large", 300)
    add("fr", "large", 80)
    plain = add("en", "rare", 1) + add("fr", "other", 2) + add("xx", "none", 1) + add(None, None, 1)
    spam = add("en", "spam", 1, " $$$$$|||||<<<<<>>>>>" * 4) + add("en", "spams", 3, " #####*****%%%%%" * 4) + add("yy", "spam", 1, " &&&&&|||||" * 4)
    found = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"], Scratch(spark, "t"))
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in found.collect()}
    assert len(found) == len(rows)
    assert [found[i] for i in plain] == [(False, True)] * len(plain)
    assert [found[i] for i in spam] == [(False, False)] * len(spam)


def plain_verdicts(rows):
    """The method in numpy: a row (lang, source, vector) -> kept."""
    floor, d = np.diag([f**2 for _, f in outliers.DIMS]), len(outliers.DIMS)

    def squared(x, m, c):
        return np.sum(np.linalg.solve(np.linalg.cholesky(c + floor), (x - m).T) ** 2, axis=0)

    def estimate(x):
        found = []
        q = np.array([[sorted(v)[max(0, int(np.ceil(p * len(v))) - 1)] for v in x.T] for p in (0.25, 0.5, 0.75)])
        for m, c in ((q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)), (x.mean(0), np.cov(x.T, bias=True))):
            for _ in range(outliers.STEPS):
                bins = np.floor(np.log2(squared(x, m, c) + 1e-9) * outliers.BINS_AN_OCTAVE)
                near = x[bins <= np.sort(bins)[int(np.ceil(outliers.SHARE * len(x))) - 1]]
                m, c = near.mean(0), np.cov(near.T, bias=True)
            found.append((np.linalg.slogdet(c + floor)[1], len(found), m, c))
        _, _, m, c = min(found, key=lambda f: f[:2])
        near = x[squared(x, m, c) / (outliers.SHARE / 0.56) <= outliers.chi_square(0.975, d)]
        return len(near), near.mean(0), np.cov(near.T, bias=True)

    def shrink(own, above):
        w = own[0] / (own[0] + outliers.PSEUDO_ROWS)
        return own[0], w * own[1] + (1 - w) * above[1], w * own[2] + (1 - w) * above[2]

    x = np.array([r[2] for r in rows])
    pick = lambda f: estimate(x[[i for i, r in enumerate(rows) if f(r)]])
    every, verdicts = pick(lambda r: True), [None] * len(rows)
    for lang in {r[0] for r in rows}:
        of_lang = shrink(pick(lambda r: r[0] == lang), every)
        for source in {r[1] for r in rows if r[0] == lang}:
            own = shrink(pick(lambda r: r[:2] == (lang, source)), of_lang)
            for i, r in enumerate(rows):
                if r[:2] == (lang, source):
                    verdicts[i] = squared(x[[i]], *own[1:])[0]
    return verdicts


def test_outlier_verdicts_equal_plain_version(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    known = Scratch(spark, "t").keep(outliers.base_statistics(docs, ["doc_id", "lang", "source"]), "known").filter("not base_failed").select("doc_id", "lang", "source", *[c.alias(n) for n, c in outliers.vectors().items()]).collect()
    found = {r["doc_id"]: r["kept"] for r in outliers.judge(docs, ["doc_id"], Scratch(spark, "t")).collect()}
    distance, cut = plain_verdicts([(r["lang"], r["source"], tuple(r)[3:]) for r in known]), outliers.chi_square(1 - outliers.REJECT_AT, len(outliers.DIMS))
    sure = [(found[r["doc_id"]], v <= cut) for r, v in zip(known, distance, strict=True) if abs(v / cut - 1) > 0.02]
    assert len(sure) >= 0.99 * len(known) and all(a == b for a, b in sure) and not all(b for _, b in sure)


def test_outlier_messy(spark, messy, none):
    found = outliers.judge(messy, ["doc_id"], Scratch(spark, "t")).collect()
    want = Counter((i, *base_of(t)) for i, t, *_ in MESSY)
    assert Counter(tuple(r)[:7] for r in found) == want
    assert outliers.judge(none, ["doc_id"], Scratch(spark, "t")).count() == 0


# --- 5: top-k


def brute_top(rows, k):
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows]
    return {
        q: [(i, s) for s, i in sorted(((sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q and len(y) == len(x)), key=lambda p: (-p[0], p[1]))[:k]]
        for q, x in v
        if q % 50 == 0
    }


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_topk_blocks_equal_brute_force(spark, monkeypatch, lists):
    monkeypatch.setattr(topk, "VECTORS_A_BLOCK", 97)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 3)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(topk, "LISTS", lists)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1 if i % 3 else 0)]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.search(topk.whole_vectors(v), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 5)


def test_topk_stops_early_and_is_exact_on_large_numbers():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    ids = rng.permutation(4000)
    found = topk.block_top(ids[:40], x[:40], ids, x, 5)
    for i, best, scores, depth in found:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        assert best.tolist() == ids[order].tolist() and scores.tolist() == s[order].tolist()
    assert np.mean([depth for *_, depth in found]) < 0.3 * len(x)
    huge = np.array([[2**62, 2**61], [2**62, 2**61 - 1], [-(2**62), 3], [2**40 + 1, 5], [2**40, 6], [7, 7], [8, 8]])
    for i, best, scores, _ in topk.block_top(np.arange(7), huge, np.arange(7), huge, 3):
        exact = {j: max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(huge[i], huge[j], strict=True)))) for j in range(7) if j != i}
        want = sorted(exact, key=lambda j: (-exact[j], j))[:3]
        assert best.tolist() == want and scores.tolist() == [exact[j] for j in want]


def test_topk_messy(spark):
    rows = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [float("nan"), 1.0], 1), (1, [1.0, None], 1), (2, [1e9, 1e9], 1), (3, [1.0], 1), (None, [1.0, 1.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (5, [], 1), (150, [], 1), (200, [1e300, 1e300, 0.0], 1), (6, [1e300, 1e300, 1.0], 1), (7, [-1e300, 0.5, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = topk.search(topk.whole_vectors(v), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    found = [(r["query_id"], r["vec_id"], r["score"]) for r in found]
    assert [r for r in found if r[0] == 0] == [(0, 2, 256 * 256 * 10**9 + 512 * 256 * 10**9), (0, 4, 256 * 256 + 512 * 512), (0, 4, 256 * 256 + 512 * 512)]
    assert [r for r in found if r[0]] == [(150, 5, 0), (200, 6, 2**63 - 1), (200, 7, -(2**63))]
    assert topk.search(topk.whole_vectors(v.limit(0)), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).count() == 0


# --- 6: sharding


def test_curve_visits_neighbours(spark):
    grid = spark.range(16**3).selectExpr("id % 16 AS x", "id div 16 % 16 AS y", "id div 256 AS z")
    order = hilbert.curve_index(grid, ["x", "y", "z"], 4, "h").orderBy("h").collect()
    assert [r["h"] for r in order] == list(range(16**3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(order, order[1:], strict=False))


def test_shards(spark, docs):
    found = queries.QUERIES["op6_hilbert_shards"](spark, DATA).toPandas()
    counts = found["shard"].value_counts()
    assert len(found) == len(docs) and counts.max() - counts.min() <= 1 and set(counts.index) == set(range(8))
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {i: t.encode() for i, t, _ in docs}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in found.itertuples())


def test_shards_prune_and_messy(spark, messy, none):
    base = messy.select("doc_id", "lang", "source", "n_chars")
    placed = hilbert.hilbert_positions(base, ["lang", "source", "n_chars"], ["doc_id", "n_chars"], Scratch(spark, "t"))
    cut = hilbert.cut_runs(placed, len(MESSY), 3).toPandas()
    assert sorted(cut.position) == list(range(len(MESSY))) and cut["shard"].value_counts().max() == 5
    empty = hilbert.hilbert_positions(none.select("doc_id", "lang", "n_chars"), ["lang", "n_chars"], ["doc_id"], Scratch(spark, "t"))
    assert hilbert.cut_runs(empty, 0, 3).count() == 0


def test_write_shards_keeps_every_row(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS doc_id", "cast(id % 10 as string) AS a", "id div 10 AS b", "'t' AS text")
    odd = spark.createDataFrame([(1, "1", 0, "t"), (None, None, 3, "u"), (None, None, 3, "u"), (None, "x", None, None)], "doc_id long, a string, b long, text string")
    every = rows.unionByName(odd)
    hilbert.write_shards(every, ["a", "b"], str(tmp_path / "out"), Scratch(spark, "t"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(*every.columns).collect())) == Counter(map(tuple, every.collect()))
    counts = Counter(r["shard"] for r in back.select("shard").collect())
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 1


def test_string_borders_have_equal_depth(spark):
    values = spark.range(1600).selectExpr("concat(if(id = 0, 'arxiv', 'https://site'), lpad(id, 5, '0')) AS v").repartition(5)
    borders = hilbert.string_borders(values, "v", 4)
    cells = Counter(r["c"] for r in values.select(hilbert.cell(F.col("v"), borders).alias("c")).collect())
    assert len(cells) == 16 and set(cells.values()) == {100}


# --- 7: personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(s):
        d = [int(c) for c in s if c.isdigit()]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0

    checks = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": luhn, "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15}
    return {k: [m.span() for m in re.finditer(p, text) if checks[k](m.group())] for k, p in BASE.items()}


def test_base_spans_equal_patterns():
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("a.@1 2+-()9 %é4") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    assert all(pii.find(t)[0] == base_spans(t) for t in texts)


def test_added_spans_and_mask():
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x (at) y (dot) org IBAN DE89 3704 0044 0532 0130 00 https://u:p@h.org/x account no. 1234 5678'
    assert pii.masked(text) == 'token = "<secret>" <email> IBAN <account> <url> account no. <account>'
    clean = "The account of this token of the secret was at the time an open one."
    assert pii.masked(clean) == clean and pii.masked("") == ""


def test_secrets_of_any_length_are_whole():
    import random
    import time

    value = "eyJhbGciOiJIUzI1NiJ9." * 23
    assert len(value) > 480 and pii.find("token=" + value + " end")[1]["secret"] == [(6, 6 + len(value))]
    assert pii.masked(f'a token="{value}", and password: {value}!') == 'a token="<secret>", and password: <secret>!'
    assert pii.masked("token=" + "a" * 300 + "1") == "token=<secret>" and pii.masked("token=" + "a" * 300) == "token=" + "a" * 300
    assert pii.masked('token=my1token="abcd1234"') == 'token=<secret>"<secret>"' and pii.masked('token=mytoken="abcd1234"') == 'token=mytoken="<secret>"'
    # a value is the whole run of its characters after any cue
    rng, cue = random.Random(3), re.compile(r"token|secret")
    whole = re.compile(r"[\"']?\s{0,3}(?:[=:]|is\b)\s{0,3}[\"']?([A-Za-z0-9_./+=-]{8,})")
    for _ in range(5000):
        text = "".join(rng.choice(["token", "secret", "=", ":", " is ", " ", '"', "abc", "7", "-abcdefgh", "\n", "\u00e9"]) for _ in range(rng.randrange(30)))
        want = []
        for m in cue.finditer(text):
            v = whole.match(text, m.end())
            if v and re.search("[0-9]", v[1]) and (not want or v.start(1) >= want[-1][1]):
                want.append(v.span(1))
        assert pii.find(text)[1]["secret"] == want, text
    began = time.time()
    for t in ("token=", "token=1", "token:a", "=secret"):
        pii.find("token=" + t * 60_000)
    assert time.time() - began < 20


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("a", "1", "1 ", "a@", "1.", "+1", "://", "iban ", "token=", "(at)"):
        pii.find(t * 60_000)
    assert time.time() - began < 60


def test_pii_messy(spark, messy, none):
    found = {r["doc_id"]: r for r in pii.find_pii(messy).collect()}
    assert (found[9]["n_email"], found[9]["n_phone"]) == (1, 1) and found[1]["spans"] == "" == found[2]["spans"]
    kept = pii.mask(messy)
    assert kept.columns == messy.columns and kept.dtypes == messy.dtypes and kept.count() == len(MESSY) and kept.filter("text is null").count() == 2
    assert pii.find_pii(none).count() == 0 == pii.mask(none).count()


# --- 8: classifier


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_quality_classifier"](spark, d)
    rows = found.join(table(spark, d, "labels"), "doc_id").filter("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    for r in found.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_quality_messy(spark, messy, none):
    labels = spark.createDataFrame([(6, 1, "x"), (6, 1, "x"), (7, 1, "x"), (9, 0, "x"), (10, 0, "x"), (11, 0, "x"), (None, 1, "x"), (4, None, "x")], "doc_id long, quality int, text string")
    found = qda.score_documents(messy, labels, Scratch(spark, "t")).collect()
    assert len(found) == len(MESSY) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in qda.score_documents(messy, labels.limit(0), Scratch(spark, "t")).collect()} == {0.5}
    kept = qda.keep_good(messy, labels, Scratch(spark, "t"))
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} >= {6, 7}
    assert qda.score_documents(none, labels, Scratch(spark, "t")).count() == 0


# --- 9: near copies


def brute_classes(rows, percent=85):
    def shingles(text):
        w = [x.decode() for x in (text or "").encode().lower().split()]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                at[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return Counter((doc, len(sets[i]), least.get(top(i), doc)) for i, (doc, _) in enumerate(rows))


def near_copies(n, base, rng):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, len(w) // 25 + 1))):
            w[int(rng.integers(len(w)))] = f"new{rng.integers(10**6)}"
        out.append(" ".join(w[: len(w) - int(rng.integers(0, 8))]))
    return out


@pytest.mark.parametrize("pivots, block", [(2, 8), (4, 1000), (10_000, 8)])
def test_jaccard_equals_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "GROWTH", 3)
    monkeypatch.setattr(jaccard, "POSTINGS_A_TASK", 20)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words, 60))
    texts = [passage + " " + " ".join(rng.choice(words, int(rng.integers(5, 80)))) for _ in range(60)]
    for size in (12, 90, 400):
        texts += near_copies(50, rng.choice(words, size).tolist(), rng)
    texts += [texts[0], texts[0].upper(), passage, passage, "", None, "a b", "a b"]
    rows = list(enumerate(texts))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    assert Counter(map(tuple, found.collect())) == brute_classes(rows)


def test_jaccard_messy(spark, messy, none):
    found = Counter(map(tuple, jaccard.near_duplicates(messy, Scratch(spark, "t")).collect()))
    assert found == brute_classes([(r[0], r[1]) for r in MESSY])
    kept = jaccard.keep_one(messy, Scratch(spark, "t"))
    assert kept.columns == messy.columns and sorted(r["doc_id"] for r in kept.filter("doc_id in (6, 7, 8)").collect()) == [6]
    assert jaccard.near_duplicates(none, Scratch(spark, "t")).count() == 0


# --- 10: token counts


def test_tokens_equal_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op10_count_tokens"](spark, DATA).collect()}
    for i, text, _ in docs:
        n = len(sp.encode(text))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len(text.encode()), n, n > 4096)


@pytest.mark.parametrize(("chunk", "marks"), [(1, 0), (5, 2), (4096, 256)])
def test_transducer_equals_library(monkeypatch, chunk, marks):
    import random

    import sentencepiece

    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    monkeypatch.setattr(tokencount, "MARKS", marks)
    monkeypatch.setattr(tokencount, "MAX_STATES", 3000)
    model = public_tokenizers.path("piece_bpe_32k.model")
    ours, library, rng = tokencount.Counter(model), sentencepiece.SentencePieceProcessor(model_file=model), random.Random(3)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ["".join(rng.choice("aé b\n▁  thing<s>0x0A>日本😀\t\r.") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert [ours.of_text(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_chunk_maps_without_breaks():
    """A megabyte without a break is composed from state maps; a map is that of plain reading for every state it is entered in."""
    import random

    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    ours, library, rng = tokencount.Counter(model), sentencepiece.SentencePieceProcessor(model_file=model), random.Random(4)
    for text in ("ab" * 500_000, "".join(rng.choice("abcdefgh") for _ in range(200_000))):
        assert ours.of_text(text) == len(library.encode(text))
    entries = [tokencount.START] + [key for key, _ in ours.transducer.walk(tokencount.START, "internationalisation")]
    for chunk in ("alphabet", "e", " word next", "ab\ncd ef", "  "):
        mapped = tokencount.ChunkMap(ours, chunk)
        for key in entries:
            assert mapped(key)[1] == ours.transducer.read(key, chunk.replace(" ", tokencount.SPACE))[1]


def test_tokens_messy(spark, messy, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = tokencount.count_tokens(messy, model)
    assert found.count() == len(MESSY) and {(r["n_bytes"], r["n_tokens"]) for r in found.filter("doc_id in (1, 2)").collect()} == {(0, 0)}
    assert tokencount.count_tokens(none, model).count() == 0
