"""The pipeline's stages against plain versions of what they must keep."""

import zlib

import numpy as np
import pytest

from tessera.llm.common import Scratch, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    from tokenizers import Tokenizer

    docs, scratch = table(spark, DATA, "documents"), Scratch(spark, "t")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = scratch.keep(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, single, masked, mixed = kept
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in quality for i in good) >= 0.97 * len(good) and sum(i in quality for i, q in labels.items() if q == 0) <= 0.2 * max(1, len(labels) - len(good))
    assert all(quality[i] == before[i] for i in quality) and set(single) <= set(quality) and set(masked) == set(single) and set(mixed) <= set(masked)
    assert not any("@mail" in t for t in masked.values())
    packed = scratch.keep(corpus_pipeline.STAGES[-1][1](spark, docs, DATA), "pack").toPandas()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], at // 4096, zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted(map(tuple, packed[["doc_id", "piece", "ids_crc32"]].values.tolist())) == sorted(want)


def five_word_similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_deduplicate_takes_five_words_and_80_percent(spark):
    rng, texts = np.random.default_rng(7), {}
    for size in (60, 400, 1600):
        for k, share in enumerate((0.16, 0.20, 0.22, 0.24, 0.28, 0.32)):
            base = [f"b{size}x{k}x{i}" for i in range(size)]
            texts[len(texts)] = " ".join(base)
            texts[len(texts)] = " ".join(base + [f"t{w}" for w in rng.integers(10**9, size=int(share * size))])
    pairs = {i: five_word_similarity(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)}
    assert sum(0.8 <= s < 0.85 for s in pairs.values()) >= 6 and sum(s < 0.8 for s in pairs.values()) >= 6
    assert all(five_word_similarity(texts[i], texts[j]) == 0 for i in texts for j in texts if i // 2 < j // 2)
    want = {i for i in texts if i % 2 == 0 or pairs[i - 1] < 0.8}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, DATA).collect()} == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, words int, label string"
ODD = [
    (1, "T"), (None, "T"), (None, "U"), (None, "U"), (8, "T"), (8, "other"), (9, None), (9, None), (10, ""), (None, " \n"),
]


def odd_rows(spark):
    long = {"T": " ".join(f"t{i}" for i in range(90)), "U": " ".join(f"u{i}" for i in range(90)), "other": " ".join(f"o{i}" for i in range(90))}
    return spark.createDataFrame([(i, long.get(t, t), "en", None, 3, 1, 2, 3, "x") for i, t in ODD], SCHEMA)


def test_deduplicate_keeps_one_row_of_a_class(spark):
    kept = corpus_pipeline.deduplicate(spark, odd_rows(spark), DATA)
    found = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in kept.collect()), key=str)
    assert kept.columns == odd_rows(spark).columns
    assert found == sorted([(1, "t0"), (None, "u0"), (8, "o0"), (9, ""), (9, ""), (10, ""), (None, " \n")], key=str)


def test_all_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_rows(spark), odd_rows(spark).limit(0)):
        empty = docs.isEmpty()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, DATA)
            assert made.columns == docs.columns and (not empty or made.count() == 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert packed.count() == (0 if empty else len(ODD))
