"""Offers with a time to live, taken once: R17, as batch and as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUT = "key string, id long, offer long, outcome string"


def outcomes(rows: DataFrame, ttl: timedelta, until: Any) -> DataFrame:
    """key, id, offer, outcome of ``rows`` (key, id, offered, at) at the moment ``until``.

    An answer takes the key's latest offer if that is no older than ``ttl`` and nobody took it: ``taken``; else it is
    ``refused`` and has no offer.  An offer nobody took is ``replaced`` by a newer one within its time, or ``expired``
    (id null) when its time has passed by ``until``; offers still open have no row.  Rows of one moment count in order of id.
    """
    order = Window.partitionBy("key").orderBy("at", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = F.expr(f"interval {int(ttl.total_seconds())} seconds")
    is_offer = F.when(F.col("offered"), F.struct("id", "at"))
    seen = rows.withColumn("last", F.last(is_offer, ignorenulls=True).over(so_far)).withColumn("next", F.lead(F.when(F.col("offered"), F.col("at"))).over(order))
    answers = seen.filter("not offered").withColumn("fits", F.coalesce(F.col("at") <= F.col("last.at") + live, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("key", "last.id", "fits").orderBy("at", "id"))
    told = answers.withColumn("taken", F.col("fits") & (first == 1)).select("key", "id", F.when(F.col("taken"), F.col("last.id")).alias("offer"), F.when(F.col("taken"), "taken").otherwise("refused").alias("outcome"))
    taken = told.filter("outcome = 'taken'").select("key", F.col("offer").alias("id"), F.lit(True).alias("was_taken"))
    offers = rows.filter("offered").withColumn("newer", F.lead("at").over(order)).join(taken, ["key", "id"], "left").filter("was_taken is null")
    over = F.when(F.col("newer") <= F.col("at") + live, "replaced").when(F.col("at") + live < F.lit(until).cast(dict(rows.dtypes)["at"]), "expired")
    lapsed = offers.select("key", F.lit(None).cast("long").alias("id"), F.col("id").alias("offer"), over.alias("outcome")).filter("outcome is not null")
    return told.unionByName(lapsed)


class Offers(StatefulProcessor):
    """A key's open offer; a timer frees the state when the offer's time has passed."""

    def __init__(self, ttl: timedelta):
        self.ttl_ms = int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.offer = handle, handle.getValueState("offer", "id long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        out = []
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            at, known = int(r["at"].timestamp() * 1000), self.offer.get()
            if known and at - known[1] > self.ttl_ms:
                out.append((key[0], None, known[0], "expired"))
                self.forget(known)
                known = None
            if r["offered"]:
                if known:
                    out.append((key[0], None, known[0], "replaced"))
                    self.forget(known)
                self.offer.update((r["id"], at))
                self.handle.registerTimer(at + self.ttl_ms)
            elif known:
                out.append((key[0], r["id"], known[0], "taken"))
                self.forget(known)
            else:
                out.append((key[0], r["id"], None, "refused"))
        return iter([Row(key=k, id=i, offer=o, outcome=x) for k, i, o, x in out])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        known = self.offer.get()
        if known and known[1] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.offer.clear()
            yield Row(key=key[0], id=None, offer=known[0], outcome="expired")

    def forget(self, known: tuple[int, int]) -> None:
        self.offer.clear()
        self.handle.deleteTimer(known[1] + self.ttl_ms)

    def close(self) -> None:
        pass


def outcomes_stream(rows: DataFrame, ttl: timedelta, late: str) -> DataFrame:
    """The same over a stream, for rows no later than ``late``; needs the RocksDB state store. A key's rows count as they come, within a micro-batch by (at, id)."""
    return rows.withWatermark("at", late).groupBy("key").transformWithState(Offers(ttl), OUT, "append", "eventTime")
