"""Dates which arrive as text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "9999-01-01"


def padded_date(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day)


def earliest_date(dates: Column) -> Column:
    """The least of the texts; an all-zero date is none."""
    return F.array_min(F.filter(dates, lambda d: d != "0000-00-00"))


def valid_cut_date(date: str) -> str:
    datetime.strptime(date, "%Y-%m-%d")
    return date


def clean_date(text: Column) -> Column:
    """`Y Mon D` and `Y Mon` are read, a lone or odd rest counts as January 1 of its first word's year, failures as UNKNOWN."""
    parts = F.split(F.trim(text), " +")
    n, year = F.size(parts), F.get(parts, F.lit(0))
    day = F.to_date(F.try_to_timestamp(F.array_join(F.slice(parts, 1, 3), " "), F.lit("yyyy MMM d")))
    month = F.to_date(F.try_to_timestamp(F.array_join(F.slice(parts, 1, 2), " "), F.lit("yyyy MMM")))
    found = F.when(n == 3, day.cast("string")).when(n == 2, month.cast("string")).when(year.rlike("^[0-9]{4}$"), F.concat(year, F.lit("-01-01")))
    return F.coalesce(found, F.lit(UNKNOWN))
