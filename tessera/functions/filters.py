"""Filters of lists P02, P03, P05, P14: optional conditions joined by AND, closed vocabularies, JSON arrays, limits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds and review states a list may ask for.
KINDS, REVIEW_STATES = ("note", "task", "event", "episode"), ("confirmed", "pending")


def one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> str | None:
    """A value outside a closed vocabulary is an error."""
    if value and value not in allowed:
        raise ValueError(f"invalid {name} filter")
    return value


def clamped(limit: int, most: int = 200) -> int:
    """P14."""
    return min(max(1, limit), most)


def json_array_holds(c: Column, value: str) -> Column:
    """Null, broken or other JSON holds nothing."""
    return F.coalesce(F.array_contains(F.from_json(c, "array<string>"), value), F.lit(False))


def any_contains(columns: tuple[str, ...], needle: str) -> Column:
    """A part of any of several columns, whatever its case; null columns hold nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in columns])


def list_notes(notes: DataFrame, q: str | None = None, mention: str | None = None, kind: str | None = None, review_status: str | None = None, limit: int = 50) -> DataFrame:
    """Notes not archived that meet every option given, newest first. Without a review state those still pending are hidden."""
    kind, review_status = one_of("kind", kind, KINDS), one_of("review_status", review_status, REVIEW_STATES)
    state = F.coalesce("review_status", F.lit("confirmed"))
    options = [
        ~F.col("archived"),
        any_contains(("title", "content"), q) if q else None,
        json_array_holds(F.col("entities_mentioned"), mention) if mention else None,
        F.col("kind") == kind if kind else None,
        state == review_status if review_status else state != "pending",
    ]
    return notes.filter(reduce(and_, [o for o in options if o is not None])).orderBy(F.desc("created_at"), F.desc("id")).limit(clamped(limit))
