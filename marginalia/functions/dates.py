"""Day coercions. Every function returns a DATE column, null where no calendar day is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations in calendar order.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _pad(x: Column) -> Column:
    return F.lpad(x, 2, "0")


def _day(year: Column, month: Column, day: Column) -> Column:
    # concat, unlike concat_ws, is null where the month is unknown
    return F.concat(year, F.lit("-"), _pad(month), F.lit("-"), _pad(day)).try_cast("date")


def _month_number(word: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.substring(F.lower(word), 1, 3))
    return F.when((F.length(word) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string"))


def written_day(value: Column) -> Column:
    """The day a value names, however it is written: ISO with or without a time, slashes, day-first dots, compact,
    or with an English month name; quotes and padding are ignored. Impossible days and other text give null."""
    s = F.regexp_replace(value, r"^[\s'\"]+|[\s'\"]+$", "")
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ]+\d.*)?$"
    dotted = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    compact = r"^(\d{4})(\d{2})(\d{2})(?:T.*)?$"
    day_name = r"^(\d{1,2})(?:st|nd|rd|th|\.)?[ -]([A-Za-z]+)\.?,?[ -](\d{4})$"
    name_day = r"^([A-Za-z]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    return (
        F.when(s.rlike(iso), _day(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike(dotted), _day(part(dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when(s.rlike(compact), _day(part(compact, 1), part(compact, 2), part(compact, 3)))
        .when(s.rlike(day_name), _day(part(day_name, 3), _month_number(part(day_name, 2)), part(day_name, 1)))
        .when(s.rlike(name_day), _day(part(name_day, 3), _month_number(part(name_day, 1)), part(name_day, 2)))
    )


def iso_day(value: Column) -> Column:
    """A strict ISO day, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def session_day(date: Column, name: Column) -> Column:
    """The ``date`` key decides where it is present, even when unreadable; only an absent key falls back to the
    day in a ``session-YYYY-MM-DD`` name."""
    from_name = F.regexp_extract(name, r"^session-(\d{4}-\d{2}-\d{2})", 1)
    return F.when(date.isNotNull(), written_day(date)).otherwise(iso_day(from_name))


def note_day(valid_from: Column, date: Column, name: Column) -> Column:
    """The first ten characters of ``valid_from``, else of ``date``, else any day in the name, else ''."""

    def head(c: Column) -> Column:
        return F.nullif(F.substring(c, 1, 10), F.lit(""))

    return F.coalesce(head(valid_from), head(date), F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1))


def migration_day(date: Column, created: Column, valid_from: Column, name: Column, today: Column) -> Column:
    """A leading ISO day of date, created or valid_from, else one in the file name, else today."""

    def lead(c: Column) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))

    named = F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(lead(date), lead(created), lead(valid_from), named, today)
