"""Operator 10: token counts by a finite-state transducer compiled from a BPE vocabulary.

A byte-pair encoding that merges by score is a deterministic transduction: the encoding of ``p + c`` ends in
the one token t that is a suffix of it and may follow the last token before t, and what precedes t is the
encoding of a prefix of p.  So a state is: the longest suffix that may still grow into a token, and for each
place in it where a token may begin the last token before that place and the tokens counted since.  The
transition on c is annotated with the change of the token count.  States are compiled when first met and
shared by all texts of a Python worker; the table is emptied when it reaches a bound, so memory is bounded.

Two tokens a, b may stand side by side if encoding ``a + b`` gives a, b back; that test is memoised too.

Texts break at spaces and at characters that no token holds (line feeds here): no token spans them, so the
transducer is in its start state there.  Items from break to break are arcs of their own, remembered by text.

Every text is cut into chunks of fixed length, wherever they fall.  A chunk is a map from the state it is
entered in to the state it is left in and the tokens emitted: it is read from the start state first, and the
states met on the way are kept as marks; from any other state it is read only until it meets a mark, as the two
paths are one from there on (at a break, at the latest; in a text without breaks after a few characters).
Where they never meet, the chunk is read to its end, so the map is exact for every state.  Maps are
associative and are composed pairwise in a tree; the whole text's map, applied to the start state, gives the
count.  Rows are what Spark spreads over tasks; the tree of one text is composed within its row's task.

Edge cases: null text counts as empty: 0 bytes, 0 tokens; null ids are kept; repeated rows give repeated
rows; an empty table gives no rows; extra columns are ignored; text length is limited by memory for one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, table

LIMIT = 4096
CHUNK, MARKS = 4096, 256
START = ("", ((None, 0),))
MAX_STATES, MAX_ITEMS, MAX_PAIRS, LONGEST_KEPT = 300_000, 500_000, 500_000, 64
SPACE = "▁"
BREAK = re.compile("(?<=[^ ]) |\n")
SIMPLE = re.compile(" +[^ \n]*|\n[^ \n]*")


class Transducer:
    """Counts the tokens of one item: text without a break inside."""

    def __init__(self, scores: dict[str, float]):
        self.scores = {t: s for t, s in scores.items() if self._merged(t, scores) == [t]}
        self.all_scores = scores
        self.prefixes = {t[:n] for t in self.scores for n in range(len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    @staticmethod
    def _merged(text: str, scores: dict[str, float]) -> list[str]:
        """Plain byte-pair merging: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            at = max(range(len(parts) - 1), key=lambda i: (scores.get(parts[i] + parts[i + 1], -1e30), -i))
            if parts[at] + parts[at + 1] not in scores:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {START: 0}
        self.keys: list[tuple] = [START]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def _may_follow(self, a: str | None, b: str) -> bool:
        if a is None or a == "":
            return True
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merged(a + b, self.all_scores) == [a, b]
        return found

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The arc of a state on c. A state's key: its growing suffix, and for each place in it (first to last) None where no token may
        begin, else (last token before the place, tokens from the place to the end, counted back)."""
        tail, places = self.keys[state]
        now = 0
        for at, place in enumerate(places):
            if place is None:
                continue
            token = tail[at:] + c
            if token in self.scores and self._may_follow(place[0], token):
                last, now = token, place[1] + 1
                break
        else:  # an unknown character: its bytes, and nothing merges with it
            last, now = "", len(c.encode())
        grown, seen = tail + c, [*places, (last, now)]
        keep = next(i for i in range(len(grown) + 1) if grown[i:] in self.prefixes or i == len(grown))
        seen = [p if p is not None and grown[i:] in self.prefixes or i == len(grown) else None for i, p in enumerate(seen)][keep:]
        key = (grown[keep:], tuple(None if p is None else (p[0], p[1] - now) for p in seen))
        arc = self.arcs[state][c] = (self._state(key), now)
        return arc

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        return found

    def walk(self, key: tuple, item: str) -> Iterator[tuple[tuple, int]]:
        """The state and the tokens emitted so far, after each character."""
        total = 0
        for c in item:
            if len(self.keys) >= MAX_STATES:
                self._reset()
            state = self._state(key)
            to, more = self.arcs[state].get(c) or self._compile(state, c)
            key, total = self.keys[to], total + more
            yield key, total

    def read(self, key: tuple, item: str) -> tuple[tuple, int]:
        """The state that an item entered in ``key`` is left in, and the tokens it emits."""
        if len(self.keys) >= MAX_STATES:
            self._reset()
        arcs, state, total = self.arcs, self._state(key), 0
        for c in item:
            arc = arcs[state].get(c)
            if arc is None:
                arc = self._compile(state, c)
            state = arc[0]
            total += arc[1]
        return self.keys[state], total


class ChunkMap:
    """A chunk as a map from the state before it to (the state after it, tokens emitted)."""

    def __init__(self, counter: Counter, chunk: str):
        self.transducer = counter.transducer
        first = BREAK.search(chunk)
        self.open = (chunk[: first.start()] if first else chunk).replace(" ", SPACE)
        self.marks = [(START, 0), *islice(self.transducer.walk(START, self.open), MARKS)]
        key, n = self.marks[-1]
        left, more = self.transducer.read(key, self.open[len(self.marks) - 1 :])
        self.through = left, n + more
        self.rest = None
        if first:
            at = max(chunk.rfind(" "), chunk.rfind("\n"))
            last = at if chunk[at] == "\n" else len(chunk[: at + 1].rstrip(" "))
            left, more = self.transducer.read(START, chunk[last:].replace(" ", SPACE))
            self.rest = left, counter.items_of(chunk[first.start() : last]) + more

    def _through(self, key: tuple) -> tuple[tuple, int]:
        left, whole = self.through
        if key == START:
            return left, whole
        n, at = 0, 0
        for at, (now, n) in enumerate(islice(self.transducer.walk(key, self.open), MARKS), 1):
            key = now
            if key == self.marks[at][0]:
                return left, n + whole - self.marks[at][1]
        end, more = self.transducer.read(key, self.open[at:])
        return end, n + more

    def __call__(self, key: tuple) -> tuple[tuple, int]:
        left, n = self._through(key)
        return (left, n) if self.rest is None else (self.rest[0], n + self.rest[1])


class Composed:
    """Two neighbouring maps as one; what it does to the start state is known before anyone asks."""

    def __init__(self, first: Callable, second: Callable):
        self.first, self.second = first, second
        self.from_start = self._apply(START)

    def _apply(self, key: tuple) -> tuple[tuple, int]:
        between, n = self.first(key)
        left, more = self.second(between)
        return left, n + more

    def __call__(self, key: tuple) -> tuple[tuple, int]:
        return self.from_start if key == START else self._apply(key)


class Counter(dict):
    """Token counts of items (a space or more and a word, or a line feed and a word), remembered; of texts."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.transducer = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in pieces})
        if any("\n" in sp.id_to_piece(i) or SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in pieces):
            raise ValueError("a token of this vocabulary spans a break")

    def __missing__(self, item: str) -> int:
        spaced = item if item[:1] in (" ", "\n") else " " + item
        n = self.transducer.read(START, spaced.replace(" ", SPACE))[1]
        if len(item) <= LONGEST_KEPT:  # so that what is remembered has a bound in characters
            if len(self) >= MAX_ITEMS:
                self.clear()
            self[item] = n
        return n

    def items_of(self, spaced: str) -> int:
        """Tokens of text from a break to another one."""
        items = spaced.replace("\n", " \n").split(" ")
        if "" not in items[1:]:  # single spaces only: an item without a space or line feed stands for a space and itself
            return sum(map(self.__getitem__, items[1:]))
        return sum(map(self.__getitem__, SIMPLE.findall(spaced)))

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        maps: list[Callable] = [ChunkMap(self, text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0](START)[1]


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """One a Python worker and vocabulary."""
    return Counter(model)


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. model: a sentencepiece file that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).of_text
        for b in batches:
            n = pa.array([count(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]
    return arrow_batches(rows).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
