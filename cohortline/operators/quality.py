"""Data-quality checks: missing, conflicting and duplicate records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import same_key


def missing_rows(df: DataFrame, cols: Sequence[str], row_id: str = "ingest_id") -> DataFrame:
    """One row (column, row_id) per missing cell of `cols`."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.select(F.explode(gaps).alias("column"), row_id)


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_missing, n_present) of each column, all in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols])
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col("_rows") - F.col(c)).alias("n_missing"),
            F.col(c).alias("n_present"),
        )
        for c in cols
    ]
    return counts.select(F.inline(F.array(*cells)))


def _value_kinds(df: DataFrame, key: str, col: str) -> DataFrame:
    # A missing value counts as one more value: a key is consistent if all its values are
    # missing, or none is and the smallest equals the largest.
    present = F.count(col)
    consistent = (present == 0) | ((present == F.count(F.lit(1))) & (F.min(col) == F.max(col)))
    return df.groupBy(key).agg(consistent.alias("_consistent"))


def keys_consistent(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys whose rows all hold the same value of `col` (all missing included)."""
    return _value_kinds(df, key, col).filter("_consistent").select(key)


def keys_conflicting(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys whose rows hold more than one value of `col`, a missing one counted as a value."""
    return _value_kinds(df, key, col).filter("NOT _consistent").select(key)


def duplicate_rows(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    row_id: str = "ingest_id",
) -> DataFrame:
    """Rows that repeat the `col` value of an earlier row of the same key.

    Earlier means a smaller `row_id`; sorting by the keys and `col` first changes nothing,
    because rows compared here agree in all of them.  Only groups of two or more rows, found by one
    aggregate, are joined to the rows; in clean data they are few.
    """
    names = [*keys, col]
    marks = ["_dup_" + n for n in names]
    groups = df.groupBy(*names).agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    repeated = groups.filter("_rows > 1").drop("_rows").toDF(*marks, "_first")
    later = same_key(df, repeated, names, marks) & (df[row_id] > repeated["_first"])
    return df.join(repeated, later, "left_semi")


def repeated_label(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    label: str,
    row_id: str = "ingest_id",
) -> DataFrame:
    """Second and later rows of one label per key."""
    return duplicate_rows(df.filter(F.col(col) == label), keys, col, row_id)


def negative_duration(df: DataFrame, col: str) -> DataFrame:
    """Rows whose duration is below zero."""
    return df.filter(F.col(col) < 0)
