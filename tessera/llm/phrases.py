"""Operator 11: phrase collocations by multikey three-way quicksort of suffix pointers, routed by leading words.

1.  A first pass finds hot prefixes.  Every chunk of text reports its prefixes of one to three words that hold at
    least a share HOT / buckets of it; a prefix with twice that share of all words is reported by some chunk.
    What is gathered is at most 3 * buckets / HOT prefixes.
2.  Every word starts a suffix, cut at the end of its piece and at DEPTH words.  Equal suffixes of a chunk become
    one with a weight.  A suffix goes to the bucket of its leading word; where that is hot, of its leading two words
    (and so on), and the hot prefix itself is counted by one weighted entry a chunk.  So each phrase is counted in
    one bucket, and no bucket holds much more than the others, however often a word or a phrase occurs.
3.  A bucket sorts pointers to its suffixes: grouped by leading word, then three-way partitions at one depth after
    the other.  The weight of an equal partition is the count of its phrase; a partition (smaller, equal or larger)
    of less weight than ``least`` cannot hold a frequent phrase and is abandoned.
4.  Cuts, containment and ranks are joins and aggregates over the frequent phrases.

Edge cases: text that is null or empty has no words; null ``lang`` is ``und``; repeated rows count each time; ties of a
cut go to the earliest, of ranks to the smaller phrase in byte order; an empty table gives no rows; extra columns
are ignored.  Long texts are read in windows of WINDOW bytes that overlap by three words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, table

DEPTH, LEAST, COVER, TOP = 4, 30, 80, 2000
CHUNK, WINDOW, BUCKET_BYTES = 2_000_000, 1 << 22, 24_000_000
HOT = 0.25
SALT = 64
#: A byte that no UTF-8 text has stands for the end of a piece.
END = b"\xff"
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)
WORD = re.compile(rb"[^ ]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(text: str | None) -> Iterator[tuple[list[bytes], int]]:
    """Words and ends of pieces, window by window, and how many of them are the window's own; the rest only follow its last words."""
    data = (text or "").encode().translate(LETTERS).replace(END, b" " + END + b" ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + WINDOW)
        end = len(data) if end < 0 else end
        own = data[at:end].split()
        yield own + [m.group() for m in islice(WORD.finditer(data, end), DEPTH - 1)], len(own)
        at = end


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]]:
    """Of about CHUNK words each: (lang, distinct words, numbers of the words from 1 with 0 for ends, which of them start a suffix)."""
    words: dict[str, list[bytes]] = {}
    others: dict[str, list[tuple[int, int]]] = {}
    held = 0

    def coded() -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for lang, seen in words.items():
            c = pa.array(seen, pa.large_binary()).dictionary_encode()
            ids = c.indices.to_numpy() + 1
            ids[ids == pc.index(c.dictionary, pa.scalar(END, pa.large_binary())).as_py() + 1] = 0
            starts = ids > 0
            for lo, hi in others[lang]:
                starts[lo:hi] = False
            out.append((lang, c.dictionary, ids.astype(np.int64), starts))
        return out

    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
            mine, skip = words.setdefault(lang, []), others.setdefault(lang, [])
            for got, own in windows(text.as_py()):
                skip.append((len(mine) + own, len(mine) + len(got)))
                mine += got
                mine.append(END)
                held += own
                if held >= CHUNK:
                    yield coded()
                    words.clear()
                    others.clear()
                    mine, skip, held = words.setdefault(lang, []), others.setdefault(lang, []), 0
    if held:
        yield coded()


def suffixes(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of DEPTH words (0 after a piece's end), sorted, one column each, and how often each occurs."""
    at = np.flatnonzero(starts)
    padded = np.concatenate([ids, np.zeros(DEPTH, np.int64)])
    w = np.empty((DEPTH, len(at)), np.int64)
    w[0] = ids[at]
    for d in range(1, DEPTH):
        w[d] = np.where(w[d - 1] > 0, padded[at + d], 0)
    base = ids.max(initial=0) + 1
    one, two = w[0] * base + w[1], w[2] * base + w[3]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(at) else at
    return w[:, order[first]], np.diff(np.append(first, len(at)))


def prefix_groups(w: np.ndarray, depth: int) -> np.ndarray:
    """Where, in sorted suffixes, a new prefix of ``depth`` words starts."""
    new = np.zeros(w.shape[1], bool)
    new[:1] = True
    for d in range(depth):
        new[1:] |= w[d, 1:] != w[d, :-1]
    return np.flatnonzero(new)


def hot_prefixes(docs: DataFrame, share: float) -> DataFrame:
    """lang, words (none: all of the language), c: per chunk, the prefixes of one to three words that hold at least ``share`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in chunks(batches):
            least = share * sum(int(starts.sum()) for *_, starts in parts)
            out: list[tuple[str, list[bytes], int]] = []
            for lang, names, ids, starts in parts:
                out.append((lang, [], int(starts.sum())))
                at = np.flatnonzero(starts)
                padded = np.concatenate([ids, np.zeros(DEPTH, np.int64)])
                group, prefixes = np.zeros(len(at), np.int64), [[]]
                for d in range(DEPTH - 1):  # only suffixes below a hot prefix go on
                    word = padded[at + d]
                    at, group, word = at[word > 0], group[word > 0], word[word > 0]
                    keys, back, c = np.unique(group * (len(names) + 1) + word, return_inverse=True, return_counts=True)
                    hot = np.flatnonzero(c >= least)
                    prefixes = [[*prefixes[keys[i] // (len(names) + 1)], names[int(keys[i] % (len(names) + 1)) - 1].as_py()] for i in hot]
                    out += [(lang, p, int(c[i])) for p, i in zip(prefixes, hot, strict=True)]
                    number = np.full(len(keys), -1)
                    number[hot] = np.arange(len(hot))
                    stay = number[back] >= 0
                    at, group = at[stay], number[back][stay]
            lang, words, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(words, pa.list_(pa.binary())), pa.array(c, pa.int64())], ["lang", "words", "c"])

    found = arrow_batches(docs).mapInArrow(run, "lang string, words array<binary>, c long")
    return found.groupBy("lang", "words").agg(F.sum("c").alias("c"))


def routed(docs: DataFrame, buckets: int, hot: dict[str, set[tuple[bytes, ...]]]) -> DataFrame:
    """bucket, lang, words, ids, lo, weight: the weighted suffixes of a chunk by bucket, numbered by the words of that row alone.

    ``lo``: the least depth at which the bucket counts a suffix; its shorter prefixes are hot and counted elsewhere.
    """

    def hot_depth(w: np.ndarray, names: pa.Array, mine: set[tuple[bytes, ...]]) -> np.ndarray:
        """How many leading words of each suffix are hot prefixes."""
        depth, base = np.zeros(w.shape[1], np.int8), len(names) + 1
        flat = sorted({x for p in mine for x in p})
        place_of = dict(zip(flat, pc.index_in(pa.array(flat, pa.large_binary()), value_set=names).to_pylist(), strict=True))
        known = {p: [place_of[x] for x in p] for p in mine}
        group, ranks = np.zeros(w.shape[1], np.int64), {(): 0}
        inside = np.ones(w.shape[1], bool)
        for d in range(1, DEPTH):
            keys = {ranks[p[:-1]] * base + ids[-1] + 1: p for p, ids in known.items() if len(p) == d and p[:-1] in ranks and None not in ids}
            if not keys:
                break
            sought = np.array(sorted(keys))
            key = group * base + w[d - 1]
            place = np.minimum(np.searchsorted(sought, key), len(sought) - 1)
            inside &= sought[place] == key
            depth[inside] = d
            group, ranks = place, {keys[k]: i for i, k in enumerate(sought.tolist())}
        return depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in chunks(batches):
            for lang, names, ids, starts in parts:
                w, weight = suffixes(ids, starts)
                depth = hot_depth(w, names, hot.get(lang, set()))
                long_enough = depth < (w > 0).sum(axis=0)
                entries, los, weights = [w[:, long_enough]], [depth[long_enough] + 1], [weight[long_enough]]
                for d in range(1, DEPTH):  # the hot prefixes themselves
                    some = w[:, depth >= d]
                    if some.shape[1]:
                        first = prefix_groups(some, d)
                        own = some[:, first].copy()
                        own[d:] = 0
                        entries.append(own)
                        los.append(np.full(len(first), d, np.int8))
                        weights.append(np.add.reduceat(weight[depth >= d], first))
                w, lo, weight = np.concatenate(entries, axis=1), np.concatenate(los), np.concatenate(weights)
                hashes = np.concatenate([[np.uint64(0)], np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()), np.uint64, len(names))])
                h = hashes[w[0]] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))
                for d in range(1, DEPTH):
                    h = np.where(lo > d, (h ^ (h >> np.uint64(29))) * MIX + hashes[w[d]], h)
                if not len(lo):
                    continue
                bucket = ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                w, lo, weight, bucket = w[:, order], lo[order], weight[order], bucket[order]
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                local, rows = np.zeros(len(names) + 1, np.uint32), []
                for a, z in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    part = w[:, a:z]
                    there = np.zeros(len(names) + 1, bool)
                    there[part] = True
                    used = np.flatnonzero(there[1:]) + 1
                    local[used] = np.arange(1, len(used) + 1)
                    rows.append((int(bucket[a]), lang, b" ".join(names.take(pa.array(used - 1)).to_pylist()), local[part].tobytes(), lo[a:z].astype(np.uint8).tobytes(), weight[a:z].astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "lang", "words", "ids", "lo", "weight"])

    return arrow_batches(docs).mapInArrow(run, "bucket int, lang string, words binary, ids binary, lo binary, weight binary")


def quicksort(w: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a pointer, weight) of all prefixes of at least that weight, by three-way partitions of pointers to the suffixes ``w``.

    All partitions of a round are split at once, each by the median of three of its own words.
    """
    order = np.argsort(w[0], kind="stable")
    head = w[0][order]
    start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.empty(0, np.int64)
    size, depth, equal = np.diff(np.append(start, len(head))), np.ones(len(start), np.int64), np.ones(len(start), bool)
    while len(order):
        total = np.add.reduceat(weight[order], start)
        enough = total >= least
        ends = enough & equal
        for d in np.unique(depth[ends]):
            now = ends & (depth == d)
            yield int(d), order[start[now]], total[now]
        go_on = enough & (depth < DEPTH)
        order, size, depth = order[np.repeat(go_on, size)], size[go_on], depth[go_on]
        if not len(order):
            return
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        key = w[depth[part], order]
        a, b, c = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        beside = key - pivot[part]
        counts, places = [], []
        for side in (beside < 0, beside == 0, beside > 0):
            places.append(np.flatnonzero(side))
            counts.append(np.add.reduceat(side, start, dtype=np.int64))
        sizes = np.stack(counts, axis=1)
        begins = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
        moved = np.empty_like(order)
        for k, place in enumerate(places):
            before = np.cumsum(sizes[:, k]) - sizes[:, k]
            moved[np.repeat(begins[:, k] - before, sizes[:, k]) + np.arange(len(place))] = order[place]
        equal = np.zeros(sizes.shape, bool)
        equal[:, 1] = True
        deeper = depth[:, None] + equal
        live = (sizes > 0) & ~(equal & (pivot == 0)[:, None])  # a piece that has ended goes no deeper
        order = moved[np.repeat(live.ravel(), sizes.ravel())]
        size, depth, equal = sizes[live], deeper[live], equal[live]
        start = np.cumsum(size) - size


def counted(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, k, f: the phrases of up to DEPTH words that occur at least ``least`` times. A partition of ``rows`` holds one bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([b.drop(columns="bucket") for b in batches] or [pd.DataFrame({"lang": []})])
        for lang, g in held.groupby("lang"):
            names = pa.array(b" ".join(g["words"]).split(b" "), pa.large_binary()).dictionary_encode()
            number, at, parts = names.indices.to_numpy() + 1, 0, []
            for words, ids in zip(g["words"], g["ids"], strict=True):
                n = words.count(b" ") + 1
                parts.append(np.concatenate([[0], number[at : at + n]]).astype(np.int64)[np.frombuffer(ids, np.uint32).reshape(DEPTH, -1)])
                at += n
            w = np.concatenate(parts, axis=1)
            lo, weight = np.frombuffer(b"".join(g["lo"]), np.uint8), np.frombuffer(b"".join(g["weight"]), np.uint32).astype(np.int64)
            text, out = names.dictionary.to_pylist(), []
            for least_depth in np.unique(lo):  # suffixes below hot prefixes count from their own depth on
                mine = lo == least_depth
                some = w[:, mine]
                for d, pointer, total in quicksort(some, weight[mine], least):
                    if d >= least_depth:
                        out += [(b" ".join(text[i - 1] for i in ids).decode(), d, f) for ids, f in zip(some[:d, pointer].T.tolist(), total.tolist(), strict=True)]
            if out:
                yield pd.DataFrame(out, columns=["phrase", "k", "f"]).assign(lang=lang)[["lang", "phrase", "k", "f"]]

    return rows.mapInPandas(run, "lang string, phrase string, k int, f long")


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all words; lang, phrase, k, f: the frequent phrases)."""
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    found = scratch.keep(hot_prefixes(texts, HOT / buckets), "hot")
    total = found.filter(F.size("words") == 0).agg(F.sum("c")).first()[0] or 0
    hot: dict[str, set[tuple[bytes, ...]]] = {}  # at most 3 * buckets / HOT prefixes
    for r in found.filter((F.size("words") > 0) & (F.col("c") >= HOT / buckets * total)).select("lang", "words").collect():
        hot.setdefault(r["lang"], set()).add(tuple(map(bytes, r["words"])))
    counts = counted(routed(texts, buckets, hot).repartitionById(buckets, F.col("bucket")), least)
    return found.filter(F.size("words") == 0).select("lang", F.col("c").alias("n")), scratch.keep(counts, "counts")


def collocations(docs: DataFrame, scratch: Scratch, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of two to four words, the ``top`` of each language."""
    n, counts = phrase_counts(docs, scratch, least)
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = counts.filter("k >= 3").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    exact = "decimal(38,0)"
    covered = 100 * F.col("longer").cast(exact) >= cover * F.col("f").cast(exact)
    left = counts.filter("k >= 2").join(longer, ["lang", "phrase"], "left").filter(F.coalesce(~covered, F.lit(True)))
    cuts = left.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), words.alias("w"))
    cuts = cuts.select("lang", "phrase", "f", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    one = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0)) div (cast(l as {exact}) + r)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # one language may hold most rows: a salted round leaves at most SALT * top of each
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT lang, phrase, f, k, string_split(phrase, ' ') AS w FROM f),
inner_ AS (
  SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM s, LATERAL (SELECT unnest(range(2, k)) AS m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) WHERE k >= 3),
longer AS (SELECT lang, phrase, max(f) AS longer FROM inner_ GROUP BY ALL),
cand AS (SELECT s.* FROM s LEFT JOIN longer USING (lang, phrase) WHERE k >= 2 AND NOT coalesce(100 * longer >= 80 * f, FALSE)),
cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(w[1 : c], ' ') AS x, array_to_string(w[c + 1 :], ' ') AS y FROM cand, LATERAL (SELECT unnest(range(1, k)) AS c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, one.f AS l, two.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (one.f + two.f) AS BIGINT) AS score
  FROM cuts JOIN f one ON one.lang = cuts.lang AND one.phrase = x JOIN f two ON two.lang = cuts.lang AND two.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
