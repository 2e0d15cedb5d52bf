"""Dates, versions and digests as Column builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.text import ColumnOrName, col

MONTHS = "january february march april may june july august september october november december".split()


def civic_day(utc: ColumnOrName, zone: str = "America/Vancouver") -> Column:
    """The local date of a UTC timestamp."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), col(utc).cast("timestamp_ntz")))


def active_on(start: ColumnOrName, end: ColumnOrName, day: Column) -> Column:
    """Both ends count, null ends are open."""
    return (col(start).isNull() | (col(start) <= day)) & (col(end).isNull() | (day <= col(end)))


def term_status(start: ColumnOrName, end: ColumnOrName, today: str) -> Column:
    day = F.lit(today).cast("date")
    return F.when(col(start) > day, "upcoming").when(col(end) < day, "past").otherwise("current")


def date_in_text(text: ColumnOrName) -> Column:
    """The first date in text: year-month-day (also with _ or /), else month name, day and year; null without a real one."""
    iso = r"(\d{4})[-_/](\d{1,2})[-_/](\d{1,2})"
    named = r"(?i)\b(" + "|".join(MONTHS) + r")\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(col(text), named, 1))).cast("string")
    a = F.concat_ws("-", *[F.regexp_extract(col(text), iso, k) for k in (1, 2, 3)])
    b = F.concat_ws("-", F.regexp_extract(col(text), named, 3), month, F.regexp_extract(col(text), named, 2))
    return F.when(col(text).rlike(iso), F.try_to_date(a, "y-M-d")).when(col(text).rlike(named), F.try_to_date(b, "y-M-d"))


def date_asked(text: ColumnOrName) -> Column:
    """month, day, year (or null) of "june 29", "29 jun 2026" or 2026-06-29 in a search; null without a date.

    The first month with a day after it counts, else the first day with a month after it; a word in a month's place that
    isn't one leaves no date.
    """
    t = F.lower(col(text))
    iso = r"\b(20\d{2})-(\d{1,2})-(\d{1,2})\b"
    after = r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(20\d{2}))?\b"
    before = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})(?:,?\s+(20\d{2}))?\b"
    number = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    month = lambda word: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(word, 1, 3)).cast("int")
    made = lambda m, d, y: F.struct(m.alias("month"), d.alias("day"), y.alias("year"))
    named = lambda p, m, d: F.when((month(F.regexp_extract(t, p, m)) > 0) & number(p, d).between(1, 31), made(month(F.regexp_extract(t, p, m)), number(p, d), number(p, 3)))
    return F.when(t.rlike(iso), made(number(iso, 2), number(iso, 3), number(iso, 1))).when(t.rlike(after), named(after, 1, 2)).when(t.rlike(before), named(before, 2, 1))


def meeting_period(year: ColumnOrName, month: ColumnOrName, view: ColumnOrName, today: str) -> Column:
    """year, month and monthly of what a list of meetings was asked for: by default this year, and this month or December."""
    now = F.lit(today).cast("date")
    y = F.when(col(year).rlike(r"^[1-9]\d{3}$"), col(year).try_cast("int")).otherwise(F.year(now))
    m = F.when(col(month).rlike(r"^(?:[1-9]|1[0-2])$"), col(month).try_cast("int")).when(y == F.year(now), F.month(now)).otherwise(12)
    return F.struct(y.alias("year"), m.alias("month"), F.coalesce(col(view) == "calendar", F.lit(False)).alias("monthly"))


def kind_of(text: ColumnOrName, kinds: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first kind of which the text has a word."""
    out = None
    low = F.lower(col(text))
    for name, words in kinds.items():
        found = F.lit(False)
        for w in words:
            found |= low.contains(w)
        out = F.when(found, name) if out is None else out.when(found, name)
    return F.lit(default) if out is None else out.otherwise(default)


def older_version(version: ColumnOrName, than: str) -> Column:
    """Whether a dotted version is below another, number by number; null is older than all."""
    own = F.transform(F.split(col(version), "\\."), lambda x: x.cast("int"))
    return F.coalesce(own < F.array(*[F.lit(int(x)) for x in than.split(".")]), F.lit(True))


def canonical_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the JSON of the fields, in order of their names."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
