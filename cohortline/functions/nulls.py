"""Missing-value logic.

SQL sends an unknown test to ELSE; the registry rules keep unknown unknown in some
places and count it as "no" in others.  These helpers name the two cases.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def ifelse3(cond: Column, yes, no) -> Column:
    """`yes` / `no` by the test, and NULL where the test itself is unknown."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def known(cond: Column) -> Column:
    """The test, with unknown counted as false."""
    return F.coalesce(cond, F.lit(False))


def in_set(col: Column, values: Iterable) -> Column:
    """Membership that is false, never unknown, for a missing value."""
    return known(col.isin(list(values)))


def nulls_last(cols: Iterable[str]) -> list[Column]:
    """Ascending sort keys with missing values at the end."""
    return [F.col(c).asc_nulls_last() for c in cols]


def same_key(left, right, left_keys: Iterable[str], right_keys: Iterable[str]) -> Column:
    """Join condition under which two missing keys are the same key."""
    cond = F.lit(True)
    for a, b in zip(left_keys, right_keys, strict=True):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond
