"""Per-subject repair: fills from the subject's own rows, deduplication, ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import day_gap
from ..functions.nulls import known
from .skew import HOT_ROWS, Hot, attach, hot_keys, with_group_values, with_neighbours


def fill_from_group_min(
    df: DataFrame,
    key: str,
    target: str,
    source: str | None = None,
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A missing `target` takes the key's minimum of `source` (by default of itself)."""
    filled = with_group_values(df, [key], {"_min": F.min(source or target)}, hot, hot_rows)
    return filled.withColumn(target, F.coalesce(target, "_min")).drop("_min")


def harmonise_to_min(
    df: DataFrame, key: str, col: str, hot: Hot | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every present value becomes the key's minimum; missing stays missing."""
    marked = with_group_values(df, [key], {"_min": F.min(col)}, hot, hot_rows)
    return marked.withColumn(col, F.when(F.col(col).isNotNull(), F.col("_min"))).drop("_min")


def group_max(
    df: DataFrame,
    key: str,
    col: str,
    out: str,
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The key's maximum of `col` on every row."""
    return with_group_values(df, [key], {out: F.max(col)}, hot, hot_rows)


def group_count(
    df: DataFrame, key: str, out: str, hot: Hot | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The key's number of rows on every row."""
    return with_group_values(df, [key], {out: F.count(F.lit(1))}, hot, hot_rows)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], row_id: str = "ingest_id") -> DataFrame:
    """The row with the smallest `row_id` of each key, all columns.

    Each task keeps one row per key before the shuffle, so a key with many copies sends few.
    """
    first = Window.partitionBy(*keys).orderBy(row_id)
    return df.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy")


def ordinal(
    df: DataFrame,
    key: str,
    date: str,
    out: str = "record_count",
    row_id: str = "ingest_id",
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Position of the row in its key's history (date, missing last; then `row_id`)."""
    placed = with_neighbours(df, key, date, row_id, hot=hot, hot_rows=hot_rows)
    return placed.withColumn(out, F.col("_ordinal")).drop("_ordinal", "_prev_date", "_next")


def lead_fill(col: str, date: str, wanted: Column, max_gap: int, intent: bool = False) -> Column:
    """The fill of `gap_limited_lead_fill` for a table that has `with_neighbours` columns."""
    if intent:
        gap = day_gap(F.col("_next.date"), F.col(date))
    else:
        gap = day_gap(F.col(date), F.col("_prev_date"))
    return F.when(known(wanted & F.col(col).isNull() & (gap < max_gap)), F.col(f"_next.{col}")).otherwise(
        F.col(col)
    )


def gap_limited_lead_fill(
    df: DataFrame,
    key: str,
    date: str,
    col: str,
    label_col: str,
    label: str,
    max_gap: int,
    out: str,
    row_id: str = "ingest_id",
    intent: bool = False,
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A missing value on a labelled row takes the next row's value if the gap is small.

    As specified the gap is the one to the previous row, so a key's first row is never filled
    and the next row may be at any distance; `intent=True` measures the gap to the next row.
    """
    placed = with_neighbours(df, key, date, row_id, [col], hot, hot_rows)
    value = lead_fill(col, date, F.col(label_col) == label, max_gap, intent)
    return placed.withColumn(out, value).drop("_ordinal", "_prev_date", "_next")


def fill_from_first_returns(
    df: DataFrame,
    key: str,
    date: str,
    col: str,
    label_col: str,
    label: str,
    source_label: str,
    n: int,
    out: str,
    row_id: str = "ingest_id",
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A missing value on a labelled row takes the first present one of the key's first `n`
    rows with `source_label`."""
    if hot is None:
        hot = hot_keys(df, [key], hot_rows)
    history = Window.partitionBy(key).orderBy(F.col(date).asc_nulls_last(), F.col(row_id))
    early = (
        df.filter(F.col(label_col) == source_label)
        .select(key, date, row_id, col)
        .withColumn("_place", F.row_number().over(history))
        .filter(F.col("_place") <= n)
    )
    found = early.filter(F.col(col).isNotNull()).groupBy(key).agg(F.min_by(col, "_place").alias("_found"))
    wanted = known((F.col(label_col) == label) & F.col(col).isNull())
    return (
        attach(df, found, [key], hot)
        .withColumn(out, F.when(wanted, F.col("_found")).otherwise(F.col(col)))
        .drop("_found")
    )
