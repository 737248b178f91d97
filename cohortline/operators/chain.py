"""Several per-key repairs as one operator: one hot-key decision, one exchange by key.

A chain is a list of steps. Those that need a value of all rows of a key (minimum, maximum, count) come first, in rounds: a step joins the
round of the steps before it unless it reads a column that the round writes. All values of a round come from one window over the key or, for the rows of hot keys, from one
aggregate that is broadcast. Steps on the order of a key's history follow on one more window; they read columns as the rounds left
them, and not each other's results. Spark keeps the rows partitioned by key from the first window to the last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import skew
from .longitudinal import lead_fill
from .skew import HOT_ROWS, Hot


@dataclass(frozen=True)
class FillMin:
    """A missing `target` takes the key's minimum of `source`, by default of itself."""

    target: str
    source: str | None = None

    @property
    def reads(self) -> set[str]:
        return {self.target, self.source or self.target}

    @property
    def writes(self) -> str:
        return self.target

    def value(self) -> Column:
        return F.min(self.source or self.target)

    def apply(self, value: Column) -> Column:
        return F.coalesce(F.col(self.target), value)


@dataclass(frozen=True)
class HarmoniseMin:
    """Every present value of `col` becomes the key's minimum."""

    col: str

    @property
    def reads(self) -> set[str]:
        return {self.col}

    @property
    def writes(self) -> str:
        return self.col

    def value(self) -> Column:
        return F.min(self.col)

    def apply(self, value: Column) -> Column:
        return F.when(F.col(self.col).isNotNull(), value)


@dataclass(frozen=True)
class GroupMax:
    """The key's maximum of `col` in a column `out`."""

    col: str
    out: str

    @property
    def reads(self) -> set[str]:
        return {self.col}

    @property
    def writes(self) -> str:
        return self.out

    def value(self) -> Column:
        return F.max(self.col)

    def apply(self, value: Column) -> Column:
        return value


@dataclass(frozen=True)
class GroupCount:
    """The key's number of rows in a column `out`."""

    out: str

    @property
    def reads(self) -> set[str]:
        return set()

    @property
    def writes(self) -> str:
        return self.out

    def value(self) -> Column:
        return F.count(F.lit(1))

    def apply(self, value: Column) -> Column:
        return value


@dataclass(frozen=True)
class Ordinal:
    """The row's position in its key's history in a column `out`."""

    out: str


@dataclass(frozen=True)
class LeadFill:
    """`gap_limited_lead_fill` of `col` into `out`."""

    col: str
    label_col: str
    label: str
    max_gap: int
    out: str
    intent: bool = False


GroupStep = FillMin | HarmoniseMin | GroupMax | GroupCount
Step = GroupStep | Ordinal | LeadFill


def rounds(steps: Sequence[GroupStep]) -> list[list[GroupStep]]:
    """The steps in rounds within which none reads or writes what an earlier one writes."""
    out: list[list[GroupStep]] = []
    for step in steps:
        # What a round writes takes effect at its end: its steps read columns as they were before.
        written = {s.writes for s in out[-1]} if out else set()
        if not out or (step.reads | {step.writes}) & written:
            out.append([])
        out[-1].append(step)
    return out


def _in_rounds(rows: DataFrame, steps: Sequence[GroupStep], valued: Callable[[DataFrame, dict[str, Column]], DataFrame]) -> DataFrame:
    for part in rounds(steps):
        rows = valued(rows, {f"_value{i}": s.value() for i, s in enumerate(part)})
        rows = rows.withColumns({s.writes: s.apply(F.col(f"_value{i}")) for i, s in enumerate(part)})
        rows = rows.drop(*[f"_value{i}" for i in range(len(part))])
    return rows


def _placed(rows: DataFrame, date: str, steps: Sequence[Ordinal | LeadFill]) -> DataFrame:
    made = {}
    for s in steps:
        if isinstance(s, Ordinal):
            made[s.out] = F.col("_ordinal")
        else:
            made[s.out] = lead_fill(s.col, date, F.col(s.label_col) == s.label, s.max_gap, s.intent)
    return rows.withColumns(made).drop("_ordinal", "_prev_date", "_next")


def repair_chain(
    df: DataFrame,
    key: str,
    date: str,
    steps: Sequence[Step],
    row_id: str = "ingest_id",
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Apply the steps as if one after the other: group steps in their order, then the steps on the key's history.

    An ordered step that is followed by a group step is an error, as is one that reads another ordered step's result.
    """
    group = [s for s in steps if not isinstance(s, Ordinal | LeadFill)]
    ordered = [s for s in steps if isinstance(s, Ordinal | LeadFill)]
    if list(steps) != [*group, *ordered]:
        raise ValueError("steps on the order of rows come after those on whole keys")
    outs = [s.out for s in ordered]
    if len(set(outs)) < len(outs) or {date, row_id, key} & set(outs) or {c for s in ordered if isinstance(s, LeadFill) for c in (s.col, s.label_col)} & set(outs):
        raise ValueError("a step on the order of rows reads or overwrites another's result")
    values = list(dict.fromkeys(s.col for s in ordered if isinstance(s, LeadFill)))
    if hot is None:
        hot = skew.hot_keys(df, [key], hot_rows)

    def ordinary_path(rows: DataFrame) -> DataFrame:
        rows = _in_rounds(rows, group, lambda part, made: skew.with_group_values(part, [key], made, skew.NONE_HOT))
        if ordered:
            rows = _placed(skew.with_neighbours(rows, key, date, row_id, values, skew.NONE_HOT), date, ordered)
        return rows

    if hot is skew.NONE_HOT:
        return ordinary_path(df)
    ordinary, heavy = skew.split_hot(df, [key], hot)
    heavy = _in_rounds(heavy, group, lambda part, made: skew.broadcast_values(part, [key], made))
    if ordered:
        heavy = _placed(skew.chunked_neighbours(heavy, key, date, row_id, values, hot_rows), date, ordered)
    return reduce(DataFrame.unionByName, [ordinary_path(ordinary), heavy])
