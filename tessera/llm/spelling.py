"""Operator 13: spelling variants by composing the vocabulary's acceptor with a one-edit transducer and the acceptor again.

1.  The vocabulary: runs of letters, with seeded deletions, counted over all texts.
2.  The composed machine reads two words at once and has used its edit (state 1) or not (state 0).  It is
    partitioned by the state in which it starts: two words of c letters, or of c and c + 1, that are one edit apart share
    their first c // 2 letters, or their last.  So a word goes, for both lengths c that it takes part in, to the state that its first
    half reaches in state 0, and to that of its reversed last half; the reversed machine leaves out what the other finds.
3.  A state with more than LIMIT words is split: words with one more letter in common start in state 0 one letter
    deeper; those whose edit is that very letter start in state 1, where they have to agree in all the rest: at
    most one word a letter, or one word and its insertions.
4.  Per starting state, the words' remainders become minimal acceptors that share their states, so that two states of
    one number accept the same.  The product machine is walked from its start and every accepted pair is listed.
5.  Forms are minima over a word's pairs; roots follow forms by pointer doubling, a written table a round (a form's
    count is at least twice its word's, so rounds are few).

Edge cases: text that is null or empty has no runs; a null ``doc_id`` is written as an empty string before the colon;
repeated rows count each time; ties of the form go to the smaller word; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, table

LETTERS, OCCURRENCES, EVERY = 5, 3, 97
LIMIT = 20_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
HELD, LONG = 500_000, 1 << 22


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n of the words of at least so many letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                lower = (text.as_py() or "").encode().lower().decode()  # A-Z only
                runs = Counter(RUN.findall(lower) if len(lower) < LONG else (m.group() for m in RUN.finditer(lower)))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % EVERY == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                    if len(word) >= letters:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    found = arrow_batches(docs.select("doc_id", "text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class Acceptors:
    """Minimal acyclic acceptors with states in common: two states accept the same words if and only if they have one number."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}

    def state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, tuple(arcs.items()))
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.known[key]

    def accept(self, words: list[str]) -> int:
        """The starting state of the acceptor of ``words`` (sorted, distinct)."""
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                (final,), arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self.state(final, arcs)

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path += [([False], {}) for _ in word[same:]]
            path[-1][0][0] = True
            last = word
        close(0)
        return self.state(path[0][0][0], path[0][1])

    def common(self, a: int, b: int) -> Iterator[str]:
        """The words that both states accept."""
        todo = [(a, b, "")]
        while todo:
            a, b, read = todo.pop()
            if self.final[a] and self.final[b]:
                yield read
            one, two = self.arcs[a], self.arcs[b]
            if len(one) > len(two):
                one, two = two, one
            todo += [(q, two[c], read + c) for c, q in one.items() if c in two]

    def substituted(self, start: int) -> Iterator[tuple[str, str]]:
        """The pairs of accepted words that differ in one letter, each once."""
        edits: dict[int, list[tuple[str, str]]] = {}
        todo = [(start, "")]
        while todo:
            q, read = todo.pop()
            if q not in edits:
                arcs = list(self.arcs[q].items())
                edits[q] = [(c + s, d + s) for i, (c, p) in enumerate(arcs) for d, r in arcs[i + 1 :] for s in self.common(p, r)]
            yield from ((read + x, read + y) for x, y in edits[q])
            todo += [(p, read + c) for c, p in self.arcs[q].items()]

    def inserted(self, longer: int, shorter: int) -> Iterator[tuple[str, str]]:
        """The pairs (longer word, shorter word) that differ by one more letter, each once: of equal letters in a row the last is it."""
        todo = [(longer, shorter, "")]
        while todo:
            q, p, read = todo.pop()
            for c, r in self.arcs[q].items():
                yield from ((read + c + s, read + s) for s in self.common(r, p) if s[:1] != c)
                if c in self.arcs[p]:
                    todo.append((r, self.arcs[p][c], read + c))


def pairs_of(group: list[tuple[str, int]], c: int, shared: int) -> Iterator[tuple[str, int, str, int]]:
    """(x, n of x, y, n of y) for the words of c or c + 1 letters, the first ``shared`` in common, that are one edit apart; no pairs of two longer ones."""
    n, prefix, machine = dict(group), group[0][0][:shared], Acceptors()
    starts = [machine.accept(sorted(w[shared:] for w in n if len(w) == size)) for size in (c, c + 1)]
    for x, y in (*machine.substituted(starts[0]), *machine.inserted(starts[1], starts[0])):
        yield prefix + x, n[prefix + x], prefix + y, n[prefix + y]


def started(words: DataFrame) -> DataFrame:
    """back, c, shared, start, word, n: the starting states of each word; ``back``: the word is reversed."""
    c = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    rows = words.select("word", "n", c.alias("c")).filter("c >= 1")
    rows = rows.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "c", F.expr("c div 2").cast("int").alias("shared"), "word", "n")
    rows = rows.withColumn("word", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    return rows.withColumn("start", F.substring(F.col("word"), F.lit(1), F.col("shared")))


def deeper(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows one letter deeper in state 0; rows in state 1: back, c, shared, start, rest, word, n)."""
    size, after = F.char_length("word"), lambda k: F.substring(F.col("word"), F.col("shared") + k, F.char_length("word"))
    zero = rows.filter(size > F.col("shared")).withColumn("shared", F.col("shared") + 1).withColumn("start", F.substring(F.col("word"), F.lit(1), F.col("shared")))
    replaced = rows.filter((size == F.col("c")) & (size > F.col("shared"))).withColumns({"rest": after(2), "kind": F.lit("replace")})
    more = rows.filter(size == F.col("c") + 1).withColumns({"rest": after(2), "kind": F.lit("insert")})
    less = rows.filter(size == F.col("c")).withColumns({"rest": after(1), "kind": F.lit("insert")})
    return zero, replaced.union(more).union(less)


def composed(rows: DataFrame, one: bool) -> DataFrame:
    """x, xn, y, yn: the accepted pairs of all starting states (``one``: in state 1). Each state's words are in one partition, in a row."""
    keys = ["back", "c", "shared", "start", *(["kind", "rest"] if one else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (*keys, "word", "n")), strict=True))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["x", "xn", "y", "yn"])

        for key, g in groupby(flat, key=lambda r: r[:-2]):
            group = [r[-2:] for r in g]
            if len(group) < 2:
                continue
            back, c, shared = key[:3]
            if not one:
                found: Iterator[tuple] = pairs_of(group, c, shared)
            elif key[4] == "replace":
                found = ((*a, *b) for i, a in enumerate(group) for b in group[i + 1 :])
            else:
                short = [a for a in group if len(a[0]) == c]
                found = ((*a, *b) for a in group if len(a[0]) > c for b in short if a[0][shared] != key[5][:1])
            if back:
                half = c // 2
                found = ((x[::-1], xn, y[::-1], yn) for x, xn, y, yn in found if x[::-1][:half] != y[::-1][:half])
            out += found
            if len(out) >= 50_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    dealt = rows.select(*keys, "word", "n").repartition(*keys).sortWithinPartitions(*keys)
    return arrow_batches(dealt).mapInArrow(run, "x string, xn long, y string, yn long")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """x, xn, y, yn: all pairs of words one edit apart, each once."""
    here, found, level = started(words), [], 0
    while True:
        keys = ["back", "c", "shared", "start"]
        hot = scratch.keep(here.groupBy(*keys).agg(F.count("*").alias("k")).filter(F.col("k") > LIMIT).drop("k"), f"hot{level}")
        if hot.isEmpty():
            found.append(composed(here, False))
            break
        found.append(composed(here.join(hot, keys, "left_anti"), False))
        zero, one = deeper(here.join(hot, keys, "left_semi"))
        found.append(composed(one, True))
        here, level = scratch.keep(zero, f"zero{level}"), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for the words that have a form; ``forms``: word, form."""
    here, level = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        on = here.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = scratch.keep(here.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{level + 1}")
        if met.filter("moved").isEmpty():
            return met.select("word", "root")
        here, level = met.select("word", "root"), level + 1


def variants(docs: DataFrame, scratch: Scratch, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = scratch.keep(vocabulary(docs, letters, occurrences), "words")
    pairs = scratch.keep(near_pairs(words, scratch), "pairs")
    both = pairs.union(pairs.select("y", "yn", "x", "xn")).toDF("word", "n", "near", "near_n")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    near = near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    near = scratch.keep(near, "near")
    out = words.join(near, "word", "left").join(roots(near.filter("form is not null"), scratch), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM each),
hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, t),
cut AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (
  SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
near AS (
  SELECT x AS word, count(*) AS n_near, arg_min(y, {'less': -v.n, 'y': y}) AS form, max(v.n) AS form_n FROM p JOIN v ON v.word = y GROUP BY x),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN near USING (word)),
way AS (SELECT word, word AS at, 0 AS steps FROM f UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(way.at, way.steps) AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word GROUP BY ALL
"""
