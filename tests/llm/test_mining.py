"""Operators 11 to 13 against brute force on small and messy tables, with their limits so low that every path is taken."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrases, sketches, spelling
from tessera.llm.common import Scratch, table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, phrase string, node long, key string, label int, c int"


def rows_of(spark, texts):
    """(id, text, lang) as a table with extra columns of clashing names."""
    return spark.createDataFrame([(*t, "s", 9, "w", "p", 8, "k", 7, 6) for t in texts], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- 11


def phrases_by_hand(texts, least, cover, top):
    counts, n = {}, Counter()
    for _, text, lang in texts:
        mine = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            mine.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        inside = {}
        for p, a in f.items():
            if a >= least:
                for m in range(2, len(p)):
                    for i in range(len(p) - m + 1):
                        inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        found = []
        for p, a in f.items():
            if a >= least and len(p) > 1 and not 100 * inside.get(p, 0) >= cover * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


MESSY = [
    (1, None, "en"),
    (2, "", None),
    (3, " \t.,!\n\x0b ", "en"),
    (4, "the the the the the the the, The\tTHE the", "en"),
    (4, "the the the the the the the, The\tTHE the", "en"),
    (None, "a hot pair, a hot pair of the hot pair; a hot pair!", None),
    (7, "\x00odd   blank here É é \x85", "en"),
    (8, "x y " * 400 + "." + "one two three four five " * 90, "de"),
]


def as_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("chunk", "hot", "window"), [(2_000_000, 0.25, 1 << 22), (300, 0.25, 64), (50, 0.02, 7), (2_000_000, 100.0, 1 << 22)])
def test_phrases(spark, monkeypatch, chunk, hot, window):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "WINDOW", window)
    for least, cover, top in ((2, 80, 2000), (1, 101, 5)):
        found = phrases.collocations(rows_of(spark, MESSY), Scratch(spark, "t"), least, cover, top)
        assert as_rows(found) == phrases_by_hand(MESSY, least, cover, top)


def test_phrases_of_documents(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 5000)
    docs = table(spark, DATA, "documents")
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert as_rows(phrases.collocations(docs, Scratch(spark, "t"), 6)) == phrases_by_hand(texts, 6, 80, 2000)
    assert phrases.collocations(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_hot_prefixes_are_routed_apart(spark, monkeypatch):
    """A pair that makes up nearly all words does not gather in one bucket."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"hot pair {a} {b} ." for a, b in rng.integers(0, 3000, (60, 2))), "en") for i in range(40)]
    docs = rows_of(spark, texts).select("text", "lang")
    hot = {}
    for r in phrases.hot_prefixes(docs, 0.05).collect():
        hot.setdefault(r["lang"], set()).add(tuple(map(bytes, r["words"])))
    size = lambda h: Counter(b for r in phrases.routed(docs, 16, h).collect() for b in [r["bucket"]] * (len(r["weight"]) // 4))
    assert max(size({}).values()) > 2400 and max(size(hot).values()) < 1200


def test_quicksort_counts_and_abandons():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 4, (4, 500))
    for d in range(1, 4):
        w[d] = np.where(w[d - 1] > 0, w[d], 0)
    w = w[:, w[0] > 0]
    weight = rng.integers(1, 4, w.shape[1])
    want = Counter()
    for s, x in zip(w.T.tolist(), weight.tolist(), strict=True):
        for d in range(1, 5):
            if s[d - 1]:
                want[tuple(s[:d])] += x
    found = [(tuple(w[:d, p].tolist()), int(t)) for d, ps, ts in phrases.quicksort(w, weight, 20) for p, t in zip(ps, ts, strict=True)]
    assert len(found) == len(dict(found)) and dict(found) == {k: v for k, v in want.items() if v >= 20}


# --- 12


def classes_by_hand(texts, words, percent):
    sets = []
    for _, text, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    top = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = top[i], top[j]
            top = [a if t == b else t for t in top]
    ids = [t[0] for t in texts]
    least = {t: min((ids[i] for i, x in enumerate(top) if x == t and ids[i] is not None), default=None) for t in set(top)}
    return Counter((ids[i], len(sets[i]), least[t], ids[i] == least[t]) for i, t in enumerate(top))


def copies(seed, groups, size, words):
    """Groups of texts around one text each, of all similarities from 0.7 to 1, and texts alone."""
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"w{rng.integers(4000)}" for _ in range(words)]
        for k in range(size):
            t = list(base)
            for i in rng.choice(words, int(words * 0.002 * rng.integers(0, 50)), replace=False):
                t[i] = f"n{g}x{k}x{i}"
            out.append((len(out) * 3, " ".join(t), "en"))
    return out


ODD = [(1, None, "en"), (2, "", "en"), (3, " \n ", "en"), (40, "one", "en"), (41, "ONE", "de"), (42, "one two", None), (42, "one two", None), (43, "two one two", "en"), (None, "same text without an id", "en"), (50, "Same text without an id", "en"), (None, "alone and no id", "en")]


def found_classes(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_sketch_classes(spark):
    texts = copies(1, 5, 30, 120) + copies(2, 60, 1, 60) + ODD
    assert found_classes(sketches.near_duplicates(rows_of(spark, texts), Scratch(spark, "t"))) == classes_by_hand(texts, 2, 80)
    docs = table(spark, DATA, "documents")
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert found_classes(sketches.near_duplicates(docs, Scratch(spark, "t"))) == classes_by_hand(texts, 2, 80)
    assert sketches.near_duplicates(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(7)
    one, two = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (900, 150))
    both = np.union1d(one, two[:100])
    r = sketches.sketched([one, two[:100], both, one[:0]])
    assert (sketches.merged(r[0], r[1]) == r[2]).all() and not r[3].any()
    for shared in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
            k = round(len(x) * 2 * shared / (1 + shared))
            y = np.unique(np.concatenate([x[:k], rng.integers(0, 2**63, len(x) - k).astype(np.uint64)]))
            a, b = sketches.sketched([x, y])
            j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(sketches.estimated(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([len(x)]), np.array([len(y)]))[0] - j)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.6 * (shared * (1 - shared) / sketches.REGISTERS) ** 0.5


# --- 13


def variants_by_hand(texts, letters, occurrences):
    n = Counter()
    for doc_id, text, _ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    v = {w: c for w, c in n.items() if len(w) >= letters and c >= occurrences}
    less = {}
    for w in v:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :], len(w)), set()).add(w)
    near = {w: set() for w in v}
    for (_, short, _), ws in less.items():
        for a in ws:
            near[a] |= ws - {a}
            if short in v:
                near[a].add(short)
                near[short].add(a)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-v[x], x), default=None)
        if best is not None and v[best] >= 2 * v[w]:
            form[w] = best
    out = []
    for w, c in v.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), v[form[w]] if w in form else None))
    return sorted(out)


def words_in(spark, texts, letters=5, occurrences=3):
    found = spelling.variants(rows_of(spark, texts), Scratch(spark, "t"), letters, occurrences).collect()
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found)


RUNS = [(1, None, "en"), (2, "", "en"), (3, "abé É×÷ naïve-naïve NAÏVE 1a2b", "fr"), (None, "words word sword swords", "en"), (None, "words word sword swords", "en"), (5, "a" * 3000 + " " + "a" * 2999 + " " + "a" * 3000 + "b", "en")]


@pytest.mark.parametrize("limit", [20_000, 6, 1])
def test_variants(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "LIMIT", limit)
    rng = np.random.default_rng(11)
    dense = ["".join("aabé"[i] for i in rng.integers(0, 4, rng.integers(1, 7))) for _ in range(700)]
    texts = [(i, " ".join(dense[i * 70 : i * 70 + 70]), "en") for i in range(10)] + (RUNS if limit != 1 else RUNS[:5])
    for letters, occurrences in ((1, 1), (5, 1), (3, 2)):
        assert words_in(spark, texts, letters, occurrences) == variants_by_hand(texts, letters, occurrences)


def test_variants_of_documents(spark):
    docs = table(spark, DATA, "documents")
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert words_in(spark, texts) == variants_by_hand(texts, 5, 3)
    assert spelling.variants(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_acceptors_are_minimal():
    words = sorted({a + b + c for a in ("x", "y", "z") for b in ("", "p") for c in ("ing", "ed", "s")})
    machine = spelling.Acceptors()
    start = machine.accept(words)
    read, todo = set(), [(start, "")]
    while todo:
        q, s = todo.pop()
        if machine.final[q]:
            read.add(s)
        todo += [(p, s + c) for c, p in machine.arcs[q].items()]
    assert sorted(read) == words and len(set(machine.arcs[start].values())) == 1
    languages = []
    for q in range(len(machine.arcs)):
        languages.append(tuple(sorted(machine.common(q, q))))
    assert len(set(languages)) == len(languages)
