"""Last-writer-wins replication: R10-R12, as batch functions and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The column name that marks a deleted row.
TOMBSTONE = "-"
STATE_DAYS = 90  # longer than a peer stays away; after that a key's memory goes


def changes_since(log: DataFrame, since: int, floor: int) -> DataFrame:
    """The changes after a cursor, never those at or below the share floor."""
    return log.filter(F.col("seq") > max(since, floor))


def merge(log: DataFrame) -> DataFrame:
    """Tbl, pk, col, value: per column the value with the greatest (hlc, device); a tombstone hides columns that are not later.

    Merging the same changes again changes nothing: the maximum of a multiset ignores repeats.
    """
    last = log.groupBy("tbl", "pk", "col").agg(F.max(F.struct("hlc", "device", "value")).alias("m"))
    dead = last.filter(F.col("col") == TOMBSTONE).select("tbl", "pk", F.col("m.hlc").alias("dead"))
    live = last.filter(F.col("col") != TOMBSTONE).join(dead, ["tbl", "pk"], "left")
    return live.filter(F.col("dead").isNull() | (F.col("m.hlc") > F.col("dead"))).select("tbl", "pk", "col", F.col("m.value").alias("value"))


def twins(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Adds ``twin_of``: rows of one natural identity give way to the smallest id; null for those that stay."""
    least = F.min("id").over(Window.partitionBy(*identity))
    return rows.withColumn("twin_of", F.when(F.col("id") != least, least))


def merge_stream(log: DataFrame) -> DataFrame:
    """R11 as a stream: the changed columns of each (tbl, pk) after every micro-batch; a deleted row sends col ``-``.

    State a key: for each column the winning (hlc, device, value), tombstone included. It expires after
    STATE_DAYS without a change.
    """

    def update(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[str, tuple[str, str, Any]] = {c: tuple(v) for c, *v in state.get[0]} if state.exists else {}
        changed: set[str] = set()
        for f in frames:
            for c, value, hlc, device in zip(f["col"], f["value"], f["hlc"], f["device"], strict=True):
                if c not in known or (hlc, device, value) > known[c]:
                    known[c] = (hlc, device, value)
                    changed.add(c)
        state.update(([(c, *v) for c, v in sorted(known.items())],))
        state.setTimeoutDuration(STATE_DAYS * 86_400_000)
        dead = known.get(TOMBSTONE)
        out = [(*key, c, known[c][2]) for c in sorted(changed) if c == TOMBSTONE or dead is None or known[c][0] > dead[0]]
        yield pd.DataFrame(out, columns=["tbl", "pk", "col", "value"])

    kept = "cols array<struct<col string, hlc string, device string, value string>>"
    return log.groupBy("tbl", "pk").applyInPandasWithState(update, "tbl string, pk string, col string, value string", kept, "update", GroupStateTimeout.ProcessingTimeTimeout)
