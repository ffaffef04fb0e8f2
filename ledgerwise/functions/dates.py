"""Date functions. Every function takes and returns Columns; unreadable input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwise.functions.text import strip

_MICROS_PER_DAY = 86_400_000_000


def _to_date(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def is_strict_date(text: Column, pattern: str) -> Column:
    """Exact, zero-padded `dd-MM-yyyy` or `MM-yyyy` after trimming."""
    value = strip(text)
    if pattern == "dd-MM-yyyy":
        shaped, date = value.rlike(r"^\d{2}-\d{2}-\d{4}$"), _to_date(value, "dd-MM-yyyy")
    elif pattern == "MM-yyyy":
        shaped = value.rlike(r"^\d{2}-\d{4}$")
        date = _to_date(F.concat(F.lit("01-"), value), "dd-MM-yyyy")
    else:
        raise ValueError(f"Unsupported date pattern: {pattern}")
    return F.coalesce(shaped & date.isNotNull(), F.lit(False))


def month_start(text: Column) -> Column:
    """`M-yyyy` as the first day of that month."""
    value = strip(text)
    date = _to_date(F.concat(F.lit("1-"), value), "d-M-yyyy")
    return F.when(value.rlike(r"^\d{1,2}-\d{4}$"), date)


def month_end(text: Column) -> Column:
    """`M-yyyy` as the last day of that month."""
    return F.last_day(month_start(text))


def day_first_date(text: Column) -> Column:
    """`dd-MM-yyyy` or ISO date, judged row by row."""
    return F.coalesce(_to_date(text, "dd-MM-yyyy"), _to_date(text, "yyyy-MM-dd"))


def required_day_first_date(text: Column) -> Column:
    """As `day_first_date`, but the job fails on the first unreadable value."""
    message = F.concat(F.lit("invalid filing date: "), F.coalesce(text, F.lit("NULL")))
    return F.coalesce(day_first_date(text), F.raise_error(message).cast("date"))


def multi_format_year(text: Column) -> Column:
    """Year of the first of six formats that fits the whole value."""
    formats = (
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    )
    years = [
        F.year(_to_date(F.when(text.rlike(shape), text), pattern)) for shape, pattern in formats
    ]
    year_only = F.when(text.rlike(r"^\d{4}$") & (text != "0000"), text).cast("int")
    return F.coalesce(*years, year_only)


def compact_date_year(value: Column) -> Column:
    """Year of a `yyyyMMdd` number or string."""
    text = value.cast("string")
    return F.year(_to_date(F.when(text.rlike(r"^\d{8}$"), text), "yyyyMMdd"))


def fiscal_year_end(reporting_date: Column, fye: Column) -> Column:
    """First fiscal year-end (`MMdd`, zero padding optional) on or after a date.

    A year-end that does not exist in the year it falls into gives NULL.
    """
    padded = F.when(fye.rlike(r"^\d{1,4}$"), F.lpad(fye, 4, "0"))

    def in_year(year: Column) -> Column:
        return _to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), padded), "yyyyMMdd")

    this_year = in_year(F.year(reporting_date))
    return F.when(reporting_date <= this_year, this_year).when(
        reporting_date > this_year, in_year(F.year(reporting_date) + 1)
    )


def utc_timestamp(text: Column) -> Column:
    """Timestamps with or without an offset, as naive UTC time.

    A value without an offset is taken as UTC, whatever the session time zone is.
    """
    value = strip(text)
    has_offset = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & value.contains(":")
    instant = F.try_to_timestamp(
        F.when(has_offset, value)
        .when(value.contains(":"), F.concat(value, F.lit("Z")))
        .otherwise(F.concat(value, F.lit("T00:00:00Z")))
    )
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")
    )


def whole_days_between(start: Column, end: Column) -> Column:
    """Days from start to end, rounded down also for negative spans."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / _MICROS_PER_DAY)


def minus_days(moment: Column, days: Column) -> Column:
    """A timestamp moved back by whole days."""
    return moment - F.make_interval(days=days.cast("int"))


def year_end(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(12), F.lit(31))


def iso_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")
