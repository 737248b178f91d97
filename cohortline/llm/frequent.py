"""The most frequent rows of a table of counts, without a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Leading bits of a count that the histogram tells apart; counts below 2^BITS are told apart exactly.
BITS = 6


def most_frequent(counts: DataFrame, size: int, n: str = "n") -> DataFrame:
    """The rows with the greatest counts, as many whole classes of the histogram as hold at most `size` rows together.

    A histogram over the leading bits of the counts, some thousand rows whatever the table, gives the least count that is taken. So at most `size` rows come out, however many
    partitions there are. `counts` is read twice and should be durable. An empty table gives none.
    """
    low = F.greatest(F.floor(F.log2(F.greatest(F.col(n), F.lit(1)))).cast("int") - F.lit(BITS - 1), F.lit(0))
    step = F.expr(f"shiftleft(shiftright({n}, _low), _low)")
    classes = counts.where(F.col(n) > 0).withColumn("_low", low).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = None, 0
    for r in sorted(classes, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > size:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else F.col(n) >= least)
