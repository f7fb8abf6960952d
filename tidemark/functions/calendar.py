"""Calendar arithmetic on DATE columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(day: Column | str) -> Column:
    return F.trunc(day, "month")


def week_of(day: Column | str) -> Column:
    """Monday of the ISO week."""
    return F.trunc(day, "week")


def month_gap(start: Column, end: Column) -> Column:
    """Number of calendar-month boundaries between two dates."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def plus_months(month: Column, n: int | Column) -> Column:
    return F.add_months(month, n)


def months_until(first: Column, next_first: Column) -> Column:
    """Array of months from ``first`` up to, but without, ``next_first``."""
    return F.sequence(first, plus_months(next_first, -1), F.expr("interval 1 month"))
