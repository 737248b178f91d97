"""Projection, filtering, correction and sorting of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.dates import date_from_year as _date_from_year, parse_date
from ..functions.nulls import ifelse3, nulls_last
from .durable import durable
from .skew import attach, hot_keys

#: Rows of a table of corrections that are broadcast; each is a key and a value.
BROADCAST_ROWS = 200_000


def parse_dates(df: DataFrame, cols: Sequence[str], pattern: str = "M/d/yyyy") -> DataFrame:
    """Text columns to dates, NULL for text that is no date."""
    return df.withColumns({c: parse_date(F.col(c), pattern) for c in cols})


def date_from_year(df: DataFrame, year_col: str, out: str) -> DataFrame:
    """1 January of the year in `year_col`."""
    return df.withColumn(out, _date_from_year(F.col(year_col)))


def drop_strict(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop named columns; a name that is not there is an error."""
    absent = sorted(set(cols) - set(df.columns))
    if absent:
        raise ValueError(f"columns to drop are not in the table: {absent}")
    return df.drop(*set(cols))


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns to the front (a repeated name counts once), the rest behind them."""
    front = list(dict.fromkeys(first))
    return df.select(*front, *[c for c in df.columns if c not in front])


def cohort(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Rows with `col` in [lo, hi]."""
    return df.filter(F.col(col).between(F.lit(lo), F.lit(hi)))


def keep_label(df: DataFrame, col: str, label: str) -> DataFrame:
    """Rows with the label; a missing label is dropped."""
    return df.filter(F.col(col) == label)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Each key once, a missing key included."""
    return df.select(key).distinct()


#: Corrections that are written into the plan; more of them become a table.
FEW_CORRECTIONS = 100


def apply_corrections(
    df: DataFrame, key: str, col: str, corrections: Mapping | DataFrame, intent: bool = False, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Overwrite `col` for the given keys.

    As specified a missing key makes the value missing; `intent=True` leaves it alone. `corrections` is a mapping, or a table of two columns, key and value,
    with each key once (a repeated key is an error, a missing one corrects nothing). Without any correction nothing changes. A table is counted: up to `broadcast_rows` rows
    are broadcast, more are joined by key, and keys with very many rows of `df` get their corrections by broadcast even then.
    """
    kind = df.schema[col].dataType
    if isinstance(corrections, DataFrame):
        return _corrected_by_table(df, key, col, corrections, intent, broadcast_rows)
    if len(corrections) > FEW_CORRECTIONS:
        schema = StructType([StructField("k", df.schema[key].dataType), StructField("v", kind)])
        return _corrected_by_table(df, key, col, df.sparkSession.createDataFrame(list(corrections.items()), schema), intent, broadcast_rows)
    value = F.col(col)
    for k, v in corrections.items():
        new = F.lit(v).cast(kind)
        test = F.col(key) == F.lit(k)
        value = F.when(test, new).otherwise(value) if intent else ifelse3(test, new, value)
    return df.withColumn(col, value)


def _corrected_by_table(df: DataFrame, key: str, col: str, corrections: DataFrame, intent: bool, broadcast_rows: int) -> DataFrame:
    k, v = [F.col(f"`{c}`") for c in corrections.columns]
    table = durable(corrections.select(k.cast(df.schema[key].dataType).alias(key), v.cast(df.schema[col].dataType).alias("_correction")))
    rows, keys, missing = table.agg(F.count(F.lit(1)), F.count_distinct(key), F.count(F.when(F.col(key).isNull(), 1))).first()
    if keys + missing < rows:
        raise ValueError("a key has several corrections")
    if not rows:
        return df
    named = table.where(F.col(key).isNotNull()).select(F.col(key), "_correction", F.lit(True).alias("_corrected"))
    if rows <= broadcast_rows:
        found = df.join(F.broadcast(named.withColumnRenamed(key, "_correction_key")), F.col(key) == F.col("_correction_key"), "left").drop("_correction_key")
    else:
        found = attach(df, named, [key], hot_keys(df, [key]))
    value = F.when(F.col("_corrected"), F.col("_correction")).otherwise(F.col(col))
    if not intent:
        value = F.when(F.col(key).isNotNull(), value)
    return found.withColumn(col, value).drop("_correction", "_corrected")


def fill_constant(df: DataFrame, col: str, value) -> DataFrame:
    """Missing values become `value`."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def override_if_present(df: DataFrame, target: str, by: str) -> DataFrame:
    """`target` takes the value of `by` where that is present."""
    return df.withColumn(target, F.coalesce(by, target))


def sort_longitudinal(df: DataFrame, keys: Sequence[str], row_id: str = "ingest_id") -> DataFrame:
    """Total order by the keys, missing last, ties by `row_id`: for final output only."""
    return df.orderBy(*nulls_last(keys), F.col(row_id))
