"""Filters, ordered limits and pages over civic tables."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of procedural text, and questions that ask for it.
PROCEDURAL = ["call to order", "approval of the agenda", "adoption of the minutes", "adopt the agenda", "adjourn", "closed meeting", "be received", "late items"]
PROCEDURAL_ASKED = ["minutes", "agenda", "adjourn"]


def public_ready(with_calendar: bool = True) -> Column:
    """A meeting that the public may see: any source document, a summary, or (not for statistics) a calendar entry."""
    ready = F.coalesce(F.col("has_agenda"), F.lit(False)) | F.coalesce(F.col("has_minutes"), F.lit(False)) | F.coalesce(F.col("has_transcript"), F.lit(False)) | F.col("summary").isNotNull()
    return ready | F.col("calendar_source_id").isNotNull() if with_calendar else ready


def between(column: str, low: object = None, high: object = None) -> Column:
    """Inclusive bounds; None doesn't bound."""
    out = F.lit(True)
    if low is not None:
        out &= F.col(column) >= F.lit(low)
    if high is not None:
        out &= F.col(column) <= F.lit(high)
    return out


def meeting_list(meetings: DataFrame, status: str | None = None, organization_id: int | None = None, flags: Sequence[str] = (), start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Meetings by any of the filters, newest first, ties by id."""
    out = meetings.where(between("meeting_date", start, end))
    for column, wanted in (("status", status), ("organization_id", organization_id)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    for flag in flags:
        out = out.where(F.col(flag))
    out = out.orderBy(F.col("meeting_date").desc(), F.col("id").desc())
    return out if limit is None else out.limit(limit)


def date_bounds(meetings: DataFrame) -> DataFrame:
    return meetings.agg(F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date"))


def visible_matters(matters: DataFrame) -> DataFrame:
    return matters.where(F.col("canonical_id").isNull() & F.col("hidden").isNull())


def in_service(rows: DataFrame, intervals: DataFrame, day: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose day lies in an interval (inclusive, null is open) with the same keys; no interval, no rows."""
    i = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start_date").alias("_from"), F.col("end_date").alias("_to"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    active = (F.col("_from").isNull() | (F.col("_from") <= F.col(day))) & (F.col("_to").isNull() | (F.col(day) <= F.col("_to")))
    return rows.join(i, [*on, active], "left_semi")


def without_procedural(rows: DataFrame, column: str, question: str) -> DataFrame:
    """Leaves procedural text out, unless the question is about it."""
    if any(x in question.lower() for x in PROCEDURAL_ASKED):
        return rows
    text = F.lower(F.coalesce(column, F.lit("")))
    for phrase in PROCEDURAL:
        rows = rows.where(~text.contains(phrase))
    return rows


def keyword_match(rows: DataFrame, columns: Sequence[str], text: str, limit: int, kind: str) -> DataFrame:
    """The first rows (by id) with the text in any column, case-insensitively."""
    found = F.lit(False)
    for c in columns:
        found |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return rows.where(found).orderBy("id").limit(limit).select(F.lit(kind).alias("type"), F.col("id").cast("long").alias("id"), F.col(columns[0]).alias("content"))


def named_participant(column: str) -> Column:
    """A label that names a person."""
    name = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return (name != "") & ~name.rlike("^(unknown|anonymous|unidentified)\\b|^(speaker|participant|person)[ _-]*\\d+$")


def status_bucket() -> Column:
    status = F.col("status")
    return F.when(status == "Active", "active").when(status.isin("Adopted", "Completed"), "completed").when(status.isin("Inactive", "Denied", "Repealed"), "closed").otherwise("other")


def cursor(value: object, row_id: int) -> str:
    return base64.b64encode(json.dumps({"v": str(value), "id": row_id}).encode()).decode()


def keyset_page(rows: DataFrame, column: str, size: int, after: str | None = None) -> DataFrame:
    """A page by descending column and id, after a cursor; has_more tells whether rows follow.

    One row more than the page is read, so that no count of the table is needed.
    """
    if after:
        at = json.loads(base64.b64decode(after))
        value = F.lit(at["v"]).cast(rows.schema[column].dataType)
        rows = rows.where((F.col(column) < value) | ((F.col(column) == value) & (F.col("id") < at["id"])))
    page = rows.orderBy(F.col(column).desc(), F.col("id").desc()).limit(size + 1)
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy(F.col(column).desc(), F.col("id").desc()))  # over one page
    many = F.count(F.lit(1)).over(Window.partitionBy()) > size
    return page.withColumn("place", at).withColumn("has_more", many).where(F.col("place") <= size)


def offset_page(rows: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """Page numbers start at 1; sizes are held between 1 and 100."""
    per_page = min(max(per_page, 1), 100)
    return rows.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)


def page_count(rows: DataFrame, per_page: int) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_page)).cast("long").alias("max_page"), F.count(F.lit(1)).alias("total"))
