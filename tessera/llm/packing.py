"""Operator 3: best-fit packing with large-item matching.

Documents become token ids plus an end id; only those longer than the capacity are cut.  Lengths are whole
numbers up to the capacity, so the packing is solved on their histogram: at most 4096 counts, however many
documents there are.  Large pieces (above a third of the capacity) go two to a sequence at most: the longest
left is matched with the longest that fits beside it.  The others go, longest first, to the sequence with
the smallest gap that holds them.  Equal lengths move together, as runs: (length, ranks from lo to hi) go to
consecutive sequences at one offset.  The plan is a list of such runs, whose number depends on the capacity
only; every piece then finds its run by its rank among the pieces of its length.

Ranks: a length's pieces are dealt to hash buckets of some thousand, each a window of its own, so a frequent
length (full pieces of long documents) spreads over tasks.  Tokenising runs once; its narrow result is kept.

Edge cases: null or empty text is the end id alone; repeated rows and null ids are packed as documents of
their own; a text that is long fills several pieces, in sequences of their own but for the last; an empty
table gives no rows; extra columns are ignored; pieces equal in everything are interchangeable.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, table

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 8192
KEPT_ITEMS, RECENT_ITEMS, AT_ONCE, LONGEST_KEPT = 500_000, 500_000, 48, 64
ENDS = (".", ",")


class Encoder(dict):
    """Ids of space-free items as little-endian bytes, remembered. White space never reaches a token of this tokenizer, so a text's ids
    are those of its items in turn; nor do letters and a stop or comma share a token, so an item's ids are those of its stem and its end.
    The first items and stems met, the frequent ones, stay; later ones are forgotten when they are too many."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.recent = Tokenizer.from_file(file), {}
        self.ends = {c: self.encoded(c) for c in ".,"}
        probes = ("The", "word", "Zebra9", "x", "unbelievable", "ABC")
        if any(self.encoded(f"{a} {b}") != self.encoded(a) + self.encoded(b) for a in probes for b in (*probes, ".", ",")):
            raise ValueError("a token of this tokenizer spans white space")
        self.splits = all(self.encoded(p + c) == self.encoded(p) + e for p in probes for c, e in self.ends.items())
        self.folds = all(self.encoded(p) == self.encoded(p.lower()) for p in probes)

    def encoded(self, item: str) -> bytes:
        return np.array(self.tokenizer.encode(item, add_special_tokens=False).ids, "<u4").tobytes() if item else b""

    def stem(self, item: str) -> str:
        """The lower-case item without a stop or comma at its end, where this tokenizer is sure to give the same ids; else the item."""
        body = item[:-1] if self.splits and item[-1:] in ENDS else item
        if not body.lower().isalnum():
            return item
        return body.lower() if self.folds and body.isascii() else body

    @staticmethod
    def plain(item: str) -> bool:
        """Whether an item may be encoded beside others: letters and digits, or printable ASCII without a special token's mark."""
        return item.isalnum() or (item != "" and item.isascii() and item.isprintable() and "<|" not in item)

    def __missing__(self, item: str) -> bytes:
        stem = self.stem(item)
        if stem == item:
            found = self.recent.get(item)
            if found is None:
                found = self.encoded(item)
                if len(item) <= LONGEST_KEPT:
                    self.remember(item, found)
            return found
        found = self[stem] + (self.ends[item[-1]] if item[-1] in ENDS else b"")
        if len(self) < KEPT_ITEMS and len(item) <= LONGEST_KEPT:
            self[item] = found
        return found

    def remember(self, stem: str, ids: bytes) -> None:
        if len(self) < KEPT_ITEMS:
            self[stem] = ids
        else:
            if len(self.recent) >= RECENT_ITEMS:
                self.recent.clear()
            self.recent[stem] = ids

    def learn(self, items: list[str]) -> None:
        """Encodes stems not known yet, a few dozen a call, told apart by the places their tokens come from."""
        stems = {self.stem(x) for x in items}
        new = [x for x in stems if x not in self and x not in self.recent and len(x) <= LONGEST_KEPT and self.plain(x)]
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, starts = np.array(found.ids, "<u4"), np.array([a for a, _ in found.offsets], np.int64)
            borders = np.cumsum([len(x) + 1 for x in part])
            cuts = np.searchsorted(starts, borders).tolist()
            raw, last = ids.tobytes(), 0
            for stem, cut in zip(part, cuts, strict=True):
                self.remember(stem, raw[4 * last : 4 * cut])
                last = cut

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = [x for x in set().union(*split) if x not in self]
        self.learn(new)
        passing = {}  # kept for these texts only
        for x in new:
            ids = self[x]
            if x not in self:
                passing[x] = ids
        self.update(passing)
        for items in split:
            yield b"".join(map(self.__getitem__, items))
        for x in passing:
            del self[x]


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def cut_pieces(docs: DataFrame, file: str, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, step = encoder(file).ids_of, np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows, out = [], [[], [], [], []]
            for i, text_ids in enumerate(ids_of([t or "" for t in b.column("text").to_pylist()])):
                all_ids = text_ids + end
                for piece, at in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[at : at + step]
                    rows.append(i)
                    for column, v in zip(out, (piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def plan_packing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, lo, hi, first sequence, offset) for a histogram of lengths, sorted by length and lo."""
    left, used, runs, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a] > 0:
            b = next((x for x in reversed(large[: bisect.bisect_right(large, capacity - a)]) if left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, bins, 0)
            if b is not None:
                put(b, n, bins, a)
            leave(capacity - a - (b or 0), bins, n)
            bins += n
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[s] > 0:
            at = bisect.bisect_left(sizes, s)
            if at == len(sizes):
                n = -(-left[s] // (capacity // s))
                leave(capacity, bins, n)
                bins += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            m = min(n, left[s])
            put(s, m, first, capacity - gap)
            leave(gap, first + m, n - m)
            leave(gap - s, first, m)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a kept table) with sequence_id and offset."""
    counted = pieces.groupBy("length").agg(F.count("*").alias("n"))
    plan = plan_packing({r["length"]: r["n"] for r in counted.collect()}, capacity)  # a row a length: capacity rows at most
    buckets = counted.select("length", F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("n_buckets"))
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("n_buckets")))  # buckets: capacity rows at most
    inside = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = dealt.withColumn("inner", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("inner")).drop("n_buckets", "bucket", "inner", "earlier")
    names = [f"{n} {t}" for n, t in pieces.dtypes]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = (plan[:, 0] << 44) + plan[:, 1]
        for f in frames:
            run = plan[np.searchsorted(starts, (f["length"].to_numpy() << 44) + f["rank"].to_numpy(), side="right") - 1]
            yield f.drop(columns="rank").assign(sequence_id=run[:, 3] + f["rank"].to_numpy() - run[:, 1], offset=run[:, 4])

    return ranked.select(*pieces.columns, "rank").mapInPandas(place, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, file: str, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    return pack(scratch.keep(cut_pieces(docs, file, capacity), "pieces"), capacity)


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "op3"))
