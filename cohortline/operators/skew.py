"""Per-key work that survives a key holding a large share of the rows.

Most keys are small and a plain window by key is the cheapest plan for them.  A key with more
than `HOT_ROWS` rows is hot.  There are at most rows / HOT_ROWS hot keys whatever the data, so
tables with one row per hot key are broadcast; the rows of hot keys are never gathered in one
task.  Without hot keys (one scan of the key columns tells) the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import same_key
from .durable import durable

HOT_ROWS = 1_000_000

_HOT = "_hot_"


#: The keys were counted and none is hot; None where a caller takes `hot` says that nobody has looked yet.
NONE_HOT = False
Hot = DataFrame | Literal[False]


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Hot:
    """The keys with more than `hot_rows` rows, one row each, or `NONE_HOT`."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0]
    if largest is None or largest <= hot_rows:
        return NONE_HOT
    return durable(sizes.filter(F.col("_n") > hot_rows).select(*keys))


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, rows of hot keys; missing keys compare equal."""
    names = [_HOT + k for k in keys]
    listed = F.broadcast(hot.toDF(*names))
    on = same_key(df, listed, keys, names)
    return df.join(listed, on, "left_anti"), df.join(listed, on, "left_semi")


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], hot: Hot) -> DataFrame:
    """Left join of a one-row-per-key table; hot keys get theirs by broadcast."""
    names = [_HOT + k for k in keys]
    table = per_key.withColumnsRenamed(dict(zip(keys, names, strict=True)))

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side, same_key(rows, side, keys, names), "left").drop(*names)

    if hot is NONE_HOT:
        return joined(df, table)
    ordinary, heavy = split_hot(df, keys, hot)
    few = split_hot(per_key, keys, hot)[1].withColumnsRenamed(dict(zip(keys, names, strict=True)))
    return joined(ordinary, table).unionByName(joined(heavy, F.broadcast(few)))


def with_group_values(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Put aggregates of each key's rows on every row of that key.

    `values` maps a new column to an aggregate such as `F.min("e_date")`.  `hot` is the result
    of `hot_keys` where the caller already has it.
    """
    if hot is None:
        hot = hot_keys(df, keys, hot_rows)
    if hot is NONE_HOT:
        return _windowed_values(df, keys, values)
    ordinary, heavy = split_hot(df, keys, hot)
    return _windowed_values(ordinary, keys, values).unionByName(broadcast_values(heavy, keys, values))


def _windowed_values(rows: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    window = Window.partitionBy(*keys)
    return rows.withColumns({name: agg.over(window) for name, agg in values.items()})


def broadcast_values(heavy: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """`with_group_values` for rows of hot keys alone: one aggregate, broadcast to rows that stay where they are."""
    few = heavy.groupBy(*keys).agg(*[agg.alias(name) for name, agg in values.items()])
    names = [_HOT + k for k in keys]
    few = F.broadcast(few.withColumnsRenamed(dict(zip(keys, names, strict=True))))
    return heavy.join(few, same_key(heavy, few, keys, names), "inner").drop(*names)


def _with_blocks(heavy: DataFrame, key: str, date: str, row_id: str, hot_rows: int) -> DataFrame:
    """Add `_block`, which cuts each day of a hot key into chunks of at most about `hot_rows` rows by row id.

    The borders are measured quantiles of the row ids of each key and day with more rows than that, so ids may be sparse. They are as many as the largest
    such day needs, known to a tenth of a chunk, and there are at most rows / hot_rows such days.
    """
    days = heavy.groupBy(key, date).agg(F.count(F.lit(1)).alias("n"))
    largest = days.agg(F.max("n")).first()[0] or 0
    cuts = -(-largest // hot_rows) - 1
    if cuts <= 0:
        return heavy.withColumn("_block", F.lit(0))
    shares = [i / (cuts + 1) for i in range(1, cuts + 1)]
    borders = heavy.groupBy(F.col(key).alias("_bk"), F.col(date).alias("_bd")).agg(
        F.count(F.lit(1)).alias("_bn"), F.percentile_approx(row_id, shares, 10 * (cuts + 1)).alias("_borders")
    )
    borders = F.broadcast(durable(borders.where(F.col("_bn") > hot_rows).drop("_bn")))
    joined = heavy.join(borders, same_key(heavy, borders, [key, date], ["_bk", "_bd"]), "left")
    block = F.size(F.filter("_borders", lambda b: b < F.col(row_id)))
    return joined.withColumn("_block", F.when(F.col("_borders").isNull(), 0).otherwise(block)).drop("_bk", "_bd", "_borders")


def with_neighbours(
    df: DataFrame,
    key: str,
    date: str,
    row_id: str,
    values: Sequence[str] = (),
    hot: Hot | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Position of each row in its key's history, and what its neighbours hold.

    History order is (date, missing last; row_id).  `date` is a DATE and `row_id` a unique
    integer.  New columns: `_ordinal`, `_prev_date`, and `_next`, a struct of the next row's
    date and `values`, NULL on the last row.

    A hot key's history is cut into chunks of one date and one block of row ids between measured
    quantiles.  A chunk holds about `hot_rows` rows at most and is windowed on its own; what crosses a
    chunk's edge comes from two small tables: days per key (bounded by the calendar) and
    blocks per day (bounded by the rows of the largest day / `hot_rows`).
    """
    if dict(df.dtypes)[date] != "date":
        raise TypeError(f"{date} must be a DATE: the calendar bounds what is kept per key")
    if hot is None:
        hot = hot_keys(df, [key], hot_rows)
    if hot is NONE_HOT:
        return _windowed_neighbours(df, [key], date, row_id, values)
    ordinary, heavy = split_hot(df, [key], hot)
    near = _windowed_neighbours(ordinary, [key], date, row_id, values)
    return near.unionByName(chunked_neighbours(heavy, key, date, row_id, values, hot_rows))


def _windowed_neighbours(rows: DataFrame, by: Sequence[str], date: str, row_id: str, values: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(date).asc_nulls_last(), F.col(row_id))
    return rows.withColumns(
        {
            "_ordinal": F.row_number().over(w).cast("long"),
            "_prev_date": F.lag(date).over(w),
            "_next": F.lead(_shown(date, values)).over(w),
        }
    )


def _shown(date: str, values: Sequence[str]) -> Column:
    return F.struct(F.col(date).alias("date"), *[F.col(v) for v in values])


def chunked_neighbours(
    heavy: DataFrame, key: str, date: str, row_id: str, values: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`with_neighbours` for rows of hot keys alone."""
    heavy, shown = _with_blocks(heavy, key, date, row_id, hot_rows), _shown(date, values)
    blocks = heavy.groupBy(key, date, "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(shown, row_id).alias("head")
    )
    in_day = Window.partitionBy(key, date).orderBy("_block")
    in_key = Window.partitionBy(key).orderBy(F.col(date).asc_nulls_last())

    def before(w):
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    days = (
        blocks.groupBy(key, date)
        .agg(F.sum("n").alias("n"), F.min_by("head", "_block").alias("head"))
        .select(
            F.col(key).alias("_k"),
            F.col(date).alias("_d"),
            before(in_key).alias("_day_offset"),
            F.lag(date).over(in_key).alias("_day_prev"),
            F.lead("head").over(in_key).alias("_day_next"),
        )
    )
    blocks = blocks.select(
        F.col(key),
        F.col(date),
        F.col("_block"),
        before(in_day).alias("_block_offset"),
        F.lag(F.lit(True)).over(in_day).alias("_not_first"),
        F.lead("head").over(in_day).alias("_block_next"),
    )
    edges = blocks.join(days, same_key(blocks, days, [key, date], ["_k", "_d"])).select(
        F.col(key).alias("_k"),
        F.col(date).alias("_d"),
        F.col("_block").alias("_b"),
        (F.col("_day_offset") + F.col("_block_offset")).alias("_offset"),
        F.when(F.col("_not_first"), F.col(date)).otherwise(F.col("_day_prev")).alias("_edge_prev"),
        F.coalesce("_block_next", "_day_next").alias("_edge_next"),
    )
    chunks = _windowed_neighbours(heavy, [key, date, "_block"], date, row_id, values)
    chunks = chunks.join(edges, same_key(chunks, edges, [key, date, "_block"], ["_k", "_d", "_b"]))
    return chunks.withColumns(
        {
            "_prev_date": F.when(F.col("_ordinal") == 1, F.col("_edge_prev")).otherwise(F.col("_prev_date")),
            "_next": F.coalesce("_next", "_edge_next"),
            "_ordinal": F.col("_ordinal") + F.col("_offset"),
        }
    ).drop("_block", "_k", "_d", "_b", "_offset", "_edge_prev", "_edge_next")
