"""Threshold indicators, status flags and flag upgrades."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .nulls import ifelse3, in_set


def band(col: Column, cut: float, below: str, above: str, cut_is_below: bool) -> Column:
    """Two bands split at `cut`; a missing value has no band."""
    low = (col <= cut) if cut_is_below else (col < cut)
    return ifelse3(low, F.lit(below), F.lit(above))


def corrected_calcium(
    calcium: Column, albumin: Column, low: float = 40, high: float = 45, slope: float = 0.02
) -> Column:
    """Calcium corrected for albumin outside [low, high]; NULL if albumin is missing."""
    return (
        F.when(albumin.isNull(), F.lit(None))
        .when(albumin < low, calcium + slope * (low - albumin))
        .when(albumin > high, calcium - slope * (albumin - high))
        .otherwise(calcium)
    )


def yes_no(cond: Column) -> Column:
    """`Yes` / `No`, unknown stays unknown."""
    return ifelse3(cond, F.lit("Yes"), F.lit("No"))


def event_flag(col: Column, censored: Iterable[str]) -> Column:
    """0 for a censored outcome, 1 for any other, NULL for a missing one."""
    return ifelse3(col.isin(list(censored)), F.lit(0), F.lit(1))


def censor_label(
    col: Column, censored: Iterable[str], event: str = "Deceased", intent: bool = False
) -> Column:
    """`censored` or the event label.

    As specified a missing outcome gets the event label although `event_flag` leaves it
    missing; `intent=True` leaves both missing.
    """
    if intent:
        return ifelse3(col.isin(list(censored)), F.lit("censored"), F.lit(event))
    return F.when(in_set(col, censored), "censored").otherwise(event)


def flag_upgrade(flag: Column, cond: Column) -> Column:
    """FALSE becomes TRUE where `cond` holds; where the combined test is unknown, so is the result."""
    return ifelse3(~flag & cond, F.lit(True), flag)


def remission_by_date(flag: Column, date: Column) -> Column:
    """A FALSE flag is raised by the presence of a date."""
    return flag_upgrade(flag, date.isNotNull())


def remission_by_plan(flag: Column, plan: Column, stop: str, intent: bool = False) -> Column:
    """A FALSE flag is raised by a plan.

    As specified the test is "a plan exists OR it differs from `stop`": any plan raises the
    flag, and FALSE without a plan turns NULL.  `intent=True` raises it for a plan other than
    `stop` and otherwise keeps FALSE.
    """
    if intent:
        return flag_upgrade(flag, plan.isNotNull() & F.coalesce(plan != stop, F.lit(False)))
    return flag_upgrade(flag, plan.isNotNull() | (plan != stop))
