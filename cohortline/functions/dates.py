"""Date parsing and intervals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Days per unit of survival time (fixed values).
DAYS_PER_UNIT = {"days": 1.0, "months": 30.5, "years": 365.25}

# What a date looks like at the start of a cell, by pattern; text after it is ignored.
_PREFIX = {
    "M/d/yyyy": r"^\s*(\d{1,2}/\d{1,2}/\d{4})",
    "d/M/yyyy": r"^\s*(\d{1,2}/\d{1,2}/\d{4})",
    "yyyy-MM-dd": r"^\s*(\d{4}-\d{2}-\d{2})",
}


def parse_date(col: Column, pattern: str = "M/d/yyyy") -> Column:
    """Text to date: NULL for text that is no such date, trailing text ignored."""
    if pattern in _PREFIX:
        col = F.regexp_extract(col, _PREFIX[pattern], 1)
    return F.try_to_date(col, pattern)


def date_from_year(year: Column) -> Column:
    """1 January of the year."""
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def whole_years(start: Column, end: Column) -> Column:
    """Completed years between two dates (an age)."""
    return F.floor(F.months_between(end, start) / 12).cast("int")


def day_gap(end: Column, start: Column) -> Column:
    """Days from `start` to `end`."""
    return F.datediff(end, start)


def survival_time(start: Column, end: Column, unit: str = "months") -> Column:
    """Days from start to end in the given unit, to one decimal."""
    return F.round(F.datediff(end, start) / F.lit(DAYS_PER_UNIT[unit]), 1)
