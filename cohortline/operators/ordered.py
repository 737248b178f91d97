"""Running totals over a sorted table of any length.

Statistics over an order (risk sets, quantiles, ranks) first shrink the rows to one per distinct
value.  Up to `SORTED_ROWS` such values one task sorts them.  Beyond that Spark's range
partitioning puts about that many into a partition, each partition is summed on its own, and the
totals of the partitions before it are added.  Neither the plan nor the work for a row grows
with the number of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .durable import durable

SORTED_ROWS = 1_000_000


def count_ranges(table: DataFrame, sorted_rows: int = SORTED_ROWS) -> int:
    """Into how many ranges the table is to be cut: 1 if it is small.

    `table` should be durable: it is counted here and read again by the caller.
    """
    return max(1, -(-table.count() // sorted_rows))


def running_totals(
    table: DataFrame,
    order: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    ranges: int = 1,
    descending: bool = False,
) -> DataFrame:
    """Add `sums[col]` = total of `col` over all rows of the same `by` up to and including this one.

    With several `ranges` the range of each row is fixed by a durable copy, as the cuts are sampled.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    whole = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    if ranges <= 1:
        return table.withColumns({out: F.sum(col).over(whole) for col, out in sums.items()})

    table = durable(table.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    within = (
        Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    )
    range_key = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = Window.partitionBy(*by).orderBy(range_key).rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("_before_" + c) for c in sums]
    )
    return (
        table.withColumns({out: F.sum(col).over(within) for col, out in sums.items()})
        .join(offsets, [*by, "_range"])
        .withColumns({out: F.col(out) + F.col("_before_" + col) for col, out in sums.items()})
        .drop("_range", *["_before_" + c for c in sums])
    )
