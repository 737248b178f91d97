"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .durable import durable
from .ordered import SORTED_ROWS, count_ranges, running_totals


def freq(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of the present values."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def freq_many(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) of the present values of several columns, as text, in one pass."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    return (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Column levels that one row of a grid stands for while it is built.
GRID_BLOCK = 1_000


def _grid(rows: DataFrame, columns: DataFrame, block: int) -> DataFrame:
    """All pairs (row, column) of two tables of distinct values, built in blocks of columns.

    The columns are dealt to blocks by their number; each row meets each block once, by a join on the block's number, and is unfolded there.
    """
    numbered = durable(columns.select("column", F.lit(1).cast("long").alias("one")))
    n = numbered.count()
    placed = running_totals(numbered, "column", {"one": "upto"}, ranges=count_ranges(numbered))
    blocks = placed.groupBy(F.expr(f"CAST((upto - 1) DIV {block} AS INT)").alias("block")).agg(F.collect_list("column").alias("columns"))
    spread = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0) // block))).alias("block"))
    return spread.join(blocks, "block").select("row", F.explode("columns").alias("column"))


def crosstab_counts(
    df: DataFrame, row: str, col: str, levels: Sequence | None = None, block: int = GRID_BLOCK
) -> DataFrame:
    """Two-way counts in long form (row, column, n), zero cells kept, missing excluded.

    `levels` are the column levels; by default those that occur, however many.
    """
    present = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = present.groupBy(F.col(row).alias("row"), F.col(col).cast("string").alias("column")).agg(F.count(F.lit(1)).alias("n"))
    cells = durable(cells)
    rows = cells.select("row").distinct()
    if levels is None:
        grid = _grid(rows, cells.select("column").distinct(), block)
    else:
        grid = rows.select("row", F.explode(F.array(*[F.lit(v).cast("string") for v in levels])).alias("column"))
    return grid.join(cells, ["row", "column"], "left").na.fill(0, ["n"]).select("row", "column", "n")


def crosstabs(df: DataFrame, row: str, levels: Mapping[str, Sequence]) -> DataFrame:
    """(indicator, row, column, n) of several columns with known levels against one, zero cells kept, in one pass over the table.

    Each column has the rows that occur with a present value of it.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("string").alias("column")) for c in levels])
    present = df.filter(F.col(row).isNotNull()).select(F.col(row).alias("row"), F.inline(cells)).filter(F.col("column").isNotNull())
    counts = present.groupBy("indicator", "row", "column").agg(F.count(F.lit(1)).alias("n"))
    # One map of counts for each row of a table, so that zero cells need no join.
    by_row = counts.groupBy("indicator", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("found"))
    shown = F.create_map(*[x for c, v in levels.items() for x in (F.lit(c), F.array(*[F.lit(i).cast("string") for i in v]))])
    listed = by_row.select("indicator", "row", "found", F.explode(shown[F.col("indicator")]).alias("column"))
    return listed.select("indicator", "row", "column", F.coalesce(F.try_element_at("found", F.col("column")), F.lit(0)).alias("n"))


def six_number(df: DataFrame, col: str, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Minimum, quartiles, median, mean, maximum and missing count.

    Quartiles interpolate linearly between the two nearest values, and are exact: the column is
    reduced to value counts, which are then totalled in order.
    """
    counts = durable(df.groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k")))
    n = counts.agg(F.sum(F.when(F.col("v").isNotNull(), F.col("k")))).first()[0] or 0
    present = counts.filter(F.col("v").isNotNull())
    ranked = running_totals(present, "v", {"k": "upto"}, ranges=count_ranges(present, sorted_rows))

    def at(share: float) -> Column:
        place = (max(n, 1) - 1) * share
        low = int(place)
        below = F.min(F.when(F.col("upto") > low, F.col("v")))
        above = F.min(F.when(F.col("upto") > min(low + 1, n - 1), F.col("v")))
        return below + (above - below) * (place - low)

    missing = counts.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0))).first()[0]
    return ranked.agg(
        F.min("v").alias("minimum"),
        at(0.25).alias("q1"),
        at(0.5).alias("median"),
        (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"),
        at(0.75).alias("q3"),
        F.max("v").alias("maximum"),
        F.lit(missing).cast("long").alias("n_missing"),
    )


def rate(df: DataFrame, cond: Column, name: str = "rate", missing_is_no: bool = False) -> DataFrame:
    """(n, n_true, share) of a condition.

    Rows on which the condition is unknown are left out of `n`, or counted as "no" with
    `missing_is_no=True`.
    """
    if missing_is_no:
        cond = F.coalesce(cond, F.lit(False))
    return df.select(cond.cast("int").alias("_c")).agg(
        F.lit(name).alias("indicator"),
        F.count("_c").alias("n"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_true"),
        F.avg("_c").alias("share"),
    )


def rates(df: DataFrame, conds: dict[str, Column], missing_is_no: bool = False) -> DataFrame:
    """`rate` of several conditions, one row each, in one pass."""
    flags = {
        name: (F.coalesce(c, F.lit(False)) if missing_is_no else c).cast("int")
        for name, c in conds.items()
    }
    sums = df.agg(
        *[F.count(c).alias("n_" + name) for name, c in flags.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias("t_" + name) for name, c in flags.items()],
    )
    cells = [
        F.struct(
            F.lit(name).alias("indicator"),
            F.col("n_" + name).alias("n"),
            F.col("t_" + name).alias("n_true"),
            (F.col("t_" + name) / F.when(F.col("n_" + name) > 0, F.col("n_" + name))).alias("share"),
        )
        for name in flags
    ]
    return sums.select(F.inline(F.array(*cells)))


def ratio(df: DataFrame, col: str, a, b) -> DataFrame:
    """(n_a, n_b, ratio) of two labels of a column."""
    n_a = F.count(F.when(F.col(col) == a, 1))
    n_b = F.count(F.when(F.col(col) == b, 1))
    return df.agg(
        n_a.alias("n_a"), n_b.alias("n_b"), (n_a / F.when(n_b > 0, n_b)).alias("ratio")
    )


def share(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) of the present values of a column, e.g. a coded age or remission state."""
    counts = freq(df, col)
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())
