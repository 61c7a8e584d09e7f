"""The weekly digest's material: D01, D03."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.temporal import next_yearly
from tessera.operators.passages import found_passages
from tessera.operators.state import upsert_latest
from tessera.scratch import kept

#: How many entities are named as trends (ours).
TRENDS = 5


def occurrence(day: Column, recurring: Column, today: Column) -> Column:
    """The next date of an event: its own, or if it recurs its next anniversary."""
    return F.when(recurring, next_yearly(day, today)).otherwise(day)


def upcoming(entities: DataFrame, facts: DataFrame, notes: DataFrame, today: date, days: int) -> DataFrame:
    """id, title, day, kind, recurring: what is due from today to ``days`` later.

    Events and dated tasks that are the author's own (``owner`` null) and not archived; birthdays that active facts tell, unless an
    event or task due then names the entity in its title.
    """
    now = F.lit(today)
    inside = F.col("day").between(now, F.date_add(now, days))
    own = notes.filter("kind in ('event', 'task') and not archived and owner is null and event_date is not null")
    dated = own.select(F.col("id").cast("string").alias("id"), "title", occurrence(F.col("event_date"), F.col("recurring"), now).alias("day"), "kind", "recurring").filter(inside)
    dated = kept(dated)  # what is due is few rows, which are read several times
    told = facts.filter("predicate = 'has_birthday' and not obsoleted").select("entity_id", F.try_to_date("value").alias("born")).filter("born is not null")
    births = told.select("entity_id", next_yearly(F.col("born"), now).alias("day")).filter(inside).join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").distinct()
    births = kept(births)
    titles = dated.select("id", F.col("title").alias("text"))
    names = births.select(F.lower("canonical_name").alias("text")).distinct()  # entities of one name are one passage
    named = found_passages(titles, names.select(F.col("text").alias("item_id"), "text")).select(F.col("item_id").alias("named")).distinct()
    births = births.join(named, F.lower("canonical_name") == F.col("named"), "left_anti")
    return dated.unionByName(births.select(F.col("entity_id").cast("string").alias("id"), F.concat(F.lit("Birthday: "), "canonical_name").alias("title"), "day", F.lit("birthday").alias("kind"), F.lit(True).alias("recurring")))


def gather(entities: DataFrame, facts: DataFrame, notes: DataFrame, captures: DataFrame, validations: DataFrame, today: date, days: int = 7) -> DataFrame:
    """part, id, title, day, kind, n: a row each for what is new, due, open or trending, and a row a count.

    Frames: entities (id, canonical_name, type, created_at, last_mentioned, mention_count), facts (id, entity_id, predicate, value,
    obsoleted, created_at), notes (id, title, kind, event_date, recurring, owner, archived, created_at), captures and
    validations (created_at; validations: confirmed).  The past runs from ``days`` ago to the end of today.
    """
    past = lambda c: F.col(c).cast("date").between(F.lit(today - timedelta(days=days)), F.lit(today))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")

    def part(name: str, df: DataFrame, *, id: Column, title: Column, day: Column = none, kind: Column = none, n: Column = nothing) -> DataFrame:
        return df.select(F.lit(name).alias("part"), id.cast("string").alias("id"), title.alias("title"), day.cast("string").alias("day"), kind.alias("kind"), n.alias("n"))

    def count(name: str, df: DataFrame) -> DataFrame:
        return part("count", df.agg(F.count("*").alias("c")), id=F.lit(name), title=none, n=F.col("c"))

    new_entities, new_facts = entities.filter(past("created_at")), facts.filter(past("created_at") & ~F.col("obsoleted"))
    new_notes = notes.filter(past("created_at") & (F.col("kind") != "digest"))
    names = entities.select(F.col("id").alias("entity_id"), "canonical_name")
    mentioned = entities.filter(past("last_mentioned")).orderBy(F.desc("mention_count"), "id").limit(TRENDS)
    due = upcoming(entities, facts, notes, today, days)
    out = [
        part("new_entity", new_entities, id=F.col("id"), title=F.col("canonical_name"), kind=F.col("type")),
        part("new_fact", new_facts.join(names, "entity_id"), id=F.col("id"), title=F.concat_ws(" ", "canonical_name", "predicate", "value")),
        part("new_note", new_notes, id=F.col("id"), title=F.col("title"), kind=F.col("kind")),
        part("trend", mentioned, id=F.col("id"), title=F.col("canonical_name"), n=F.col("mention_count")),
        part("upcoming", due, id=F.col("id"), title=F.col("title"), day=F.col("day"), kind=F.col("kind")),
        part("open_task", notes.filter("kind = 'task' and not archived and owner is null"), id=F.col("id"), title=F.col("title"), day=F.col("event_date")),
        count("captures", captures.filter(past("created_at"))),
        count("new_entities", new_entities),
        count("new_facts", new_facts),
        count("validated_facts", validations.filter(past("created_at") & F.col("confirmed"))),
        count("new_notes", new_notes),
    ]
    week = out[0]
    for p in out[1:]:
        week = week.unionByName(p)
    return week


def has_content(week: DataFrame) -> bool:
    """Whether a week is worth a digest: something came in, is due or is open; validations and trends alone do not count."""
    told = (F.col("part").isin("upcoming", "open_task")) | ((F.col("part") == "count") & (F.col("id") != "validated_facts") & (F.col("n") > 0))
    return not week.filter(told).isEmpty()


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", day).cast("date")


def upserted(digests: DataFrame, new: DataFrame) -> DataFrame:
    """Of each title (one a week) the latest digest (title, content, created_at); of equal times the new one."""
    return upsert_latest(digests, new, "title", "created_at")
