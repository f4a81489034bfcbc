"""Scalar expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_ranges(year: Column) -> Column:
    """Of each month: month, its first day, its last day and the first day of the next month, to be used as a half-open range."""
    first = lambda m: F.make_date(year, m, F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.struct(m.alias("month"), first(m).alias("first_day"), F.last_day(first(m)).alias("last_day"), F.add_months(first(m), 1).alias("until")))


def early_year(year: Column, before: int = 2017) -> Column:
    return year < before


def in_range(ts: Column, start: Column, until: Column) -> Column:
    return (ts >= start) & (ts < until)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
