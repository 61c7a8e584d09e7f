"""When queued captures are consolidated, and a backlog that loses none of them: R16, F22."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.temporal import slot_before

HOURS, MOST = (0, 12), 30
Consolidate = Callable[[DataFrame, int, str], None]


def reason(queued: Column, stale: Column, last: Column, now: Column, hours: tuple[int, ...] = HOURS, most: int = MOST, instant: bool = False) -> Column:
    """Why a pass runs now, '' if none does: an empty queue only for stale summaries; at once if ``instant``; ``valve`` from ``most``
    captures on; ``scheduled`` if none has run since the latest scheduled hour, however long ago that was."""
    due = F.coalesce(last < slot_before(now, hours), F.lit(True))
    full = queued >= max(1, most)
    return F.when(queued == 0, F.when(stale > 0, "stale").otherwise("")).when(F.lit(instant), "instant").when(full, "valve").when(due, "scheduled").otherwise("")


def replayed(captures: DataFrame, scope: str, at: str, hours: tuple[int, ...] = HOURS, most: int = MOST) -> DataFrame:
    """scope, seq, at, reason, n: the passes that captures would have set off, had each scope's queue been looked at on the hour.

    An hour's captures count at its end.  Between two hours with captures only the schedule can act, and it acts once: at the
    first scheduled hour after the earlier one, on what is queued.  Rows are counted by hour before a scope's hours meet in a fold.
    What is still queued after the last hour with captures has no row.
    """
    hour = (F.date_trunc("hour", at) + F.expr("interval 1 hour")).cast("timestamp")
    ticks = captures.groupBy(F.col(scope).alias("scope"), hour.alias("at")).agg(F.count("*").alias("n"))
    folded = ticks.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("ticks"))  # an element an hour
    none = F.lit(None).cast("timestamp")
    run = "array<struct<at: timestamp, reason: string, n: bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("queued"), none.alias("last"), none.alias("seen"), F.array().cast(run).alias("runs"))

    def step(s: Column, t: Column) -> Column:
        first = first_slot_after(s["seen"], hours)
        caught_up = (s["queued"] > 0) & (first < t["at"])
        queued = F.when(caught_up, F.lit(0)).otherwise(s["queued"]) + t["n"]
        last = F.when(caught_up, first).otherwise(s["last"])
        why = reason(queued, F.lit(0), last, t["at"], hours, most)
        scheduled = F.when(caught_up, F.array(F.struct(first.alias("at"), F.lit("scheduled").alias("reason"), s["queued"].alias("n")))).otherwise(F.array().cast(run))
        now = F.when(why != "", F.array(F.struct(t["at"].alias("at"), why.alias("reason"), queued.alias("n")))).otherwise(F.array().cast(run))
        left = F.when(why != "", F.lit(0).cast("long")).otherwise(queued)
        return F.struct(left.alias("queued"), F.when(why != "", t["at"]).otherwise(last).alias("last"), t["at"].alias("seen"), F.concat(s["runs"], scheduled, now).alias("runs"))

    runs = folded.select("scope", F.aggregate("ticks", start, step, lambda s: s["runs"]).alias("runs"))
    return runs.select("scope", F.posexplode("runs").alias("seq", "run")).select("scope", F.col("seq").cast("long").alias("seq"), "run.at", "run.reason", "run.n")


def first_slot_after(ts: Column, hours: tuple[int, ...]) -> Column:
    """The earliest scheduled hour after a moment."""
    day = F.date_trunc("day", ts)
    slots = [day + F.expr(f"interval {24 * d + h} hours") for d in (0, 1) for h in sorted(hours)]
    out = slots[-1]
    for s in reversed(slots[:-1]):
        out = F.when(s > ts, s).otherwise(out)
    return out


class Backlog:
    """Captures that wait for a pass, in a folder that driver and executors share.

    ``captures/batch=N`` holds a micro-batch and is rewritten when the stream replays it; ``runs/run=N`` is written after
    a pass has been consolidated and holds the last batch it took.  What waits are the batches after that, whatever stopped
    in between; a pass that broke off is repeated under its old number, with all that waits by then.  So
    ``consolidate(rows, run, reason)`` must write to a place named by the run, replacing what is there; then each capture is in
    one pass.  A backlog belongs to one stream checkpoint.
    """

    def __init__(self, spark: SparkSession, root: str, consolidate: Consolidate, hours: tuple[int, ...] = HOURS, most: int = MOST, instant: bool = False):
        self.spark, self.root, self.consolidate, self.rule = spark, root.rstrip("/"), consolidate, (hours, most, instant)

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def last_run(self) -> tuple[int, int, datetime | None]:
        """Number of the last pass, the last batch it took, and when it was; (-1, -1, None) before the first."""
        if not self.exists("runs"):
            return -1, -1, None
        row = self.spark.read.schema("run long, upto long, at timestamp, reason string").parquet(f"{self.root}/runs").orderBy(F.desc("run")).first()
        return (row["run"], row["upto"], row["at"]) if row else (-1, -1, None)

    def waiting(self) -> DataFrame | None:
        """The captures no pass has taken; None before any capture."""
        if not self.exists("captures"):
            return None
        return self.spark.read.parquet(f"{self.root}/captures").filter(F.col("batch") > self.last_run()[1])

    def add(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/captures/batch={batch}")

    def tick(self, now: datetime, stale: int = 0) -> str:
        """Runs a pass if there is a reason to; returns it."""
        run, upto, last = self.last_run()
        rows = self.waiting()
        queued, newest = 0, upto
        if rows is not None:
            r = rows.agg(F.count("*").alias("n"), F.max("batch").alias("newest")).first()
            queued, newest = r["n"], upto if r["newest"] is None else r["newest"]
        moment = lambda t: F.lit(t).cast("timestamp")
        why = self.spark.range(1).select(reason(F.lit(queued), F.lit(stale), moment(last), moment(now), *self.rule)).first()[0]
        if why:
            if rows is not None:
                self.consolidate(rows.filter(F.col("batch") <= newest).drop("batch"), run + 1, why)
            done = self.spark.createDataFrame([(run + 1, newest, now, why)], "run long, upto long, at timestamp, reason string")
            done.coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        return why

    def drain(self, captures: DataFrame, checkpoint: str, clock: Callable[[], datetime], stale: Callable[[], int] = lambda: 0) -> None:
        """Takes what the stream has, looking at the queue after each micro-batch and once more at the end, as a schedule may be due without new captures."""

        def take(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            self.tick(clock(), stale())

        captures.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        self.tick(clock(), stale())
