"""Time functions T01-T12. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months, folded, in French and English; and the accents folded before they are looked for.
MONTHS = (
    "janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
MONTH_ACCENTS = ("éèêëàâäûüùîïôö", "eeeeaaauuuiioo")


def days_between(now: Column, anchor: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(anchor.cast("timestamp"))) / 86_400_000_000


def decay(now: Column, anchor: Column, tau: float = 30.0) -> Column:
    """exp(-days / tau); anchors in the future count as now."""
    return F.exp(-F.greatest(F.lit(0.0), days_between(now, anchor)) / tau)


def reactivated(now: Column, anchor: Column, factor: float) -> Column:
    """The anchor moved towards now by a share (T02), in whole seconds."""
    a, n = F.unix_seconds(anchor.cast("timestamp")), F.unix_seconds(now.cast("timestamp"))
    return F.timestamp_seconds(a + F.floor(factor * (n - a)))


def next_yearly(day: Column, today: Column) -> Column:
    """The next anniversary at or after today; 29 February falls on the 28th in other years."""
    this = F.add_months(day, (12 * (F.year(today) - F.year(day))).cast("int"))
    return F.when(this >= today, this).otherwise(F.add_months(day, (12 * (F.year(today) - F.year(day) + 1)).cast("int")))


def slot_before(ts: Column, hours: tuple[int, ...]) -> Column:
    """The latest scheduled hour at or before a moment."""
    past = F.filter(F.array(*map(F.lit, sorted(hours))), lambda h: h <= F.hour(ts))
    day = F.date_trunc("day", ts)
    today = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + 3600 * F.array_max(past))
    return F.when(F.size(past) > 0, today).otherwise(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) - 86_400 + 3600 * max(hours)))


def nearest_weekday(day: Column, target: Column) -> Column:
    """The date moved by -3..+3 days to a weekday (0: Monday)."""
    step = F.pmod(target - F.weekday(day), F.lit(7))
    return F.date_add(day, F.when(step > 3, step - 7).otherwise(step).cast("int"))


def names_month(text: Column) -> Column:
    folded = F.translate(F.lower(text), *MONTH_ACCENTS)
    return F.coalesce(folded.rlike("|".join(MONTHS)), F.lit(False))


def month_snap(day: Column, today: Column, kind: Column, text: Column) -> Column:
    """A bare day of the month moved by one month to the side that its kind looks to, if that month has the day.

    Episodes lie at or before today, events and tasks after it; other kinds, and texts that name a month, leave the day as it is.
    """
    wrong = F.when(kind == "episode", day > today).when(kind.isin("event", "task"), day <= today).otherwise(F.lit(False))
    moved = F.when(kind == "episode", F.add_months(day, -1)).otherwise(F.add_months(day, 1))
    return F.when(wrong & ~names_month(text) & (F.dayofmonth(moved) == F.dayofmonth(day)), moved).otherwise(day)
