"""Kaplan-Meier estimates and what is read off them.

All rows are first reduced to one per stratum and distinct time; everything after that runs on
that much smaller table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .durable import durable
from .ordered import SORTED_ROWS, count_ranges, running_totals

Z95 = 1.959963984540054  # two-sided 95 % point of the normal distribution
_TOL = 1e-8


def kaplan_meier(
    df: DataFrame,
    time: str,
    status: str,
    strata: Sequence[str] = (),
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """The estimate at each distinct time, with 95 % limits on the log scale.

    Columns: strata, time, n_risk, n_event, n_censor, surv, surv_before (just before this time),
    std_err (of surv, Greenwood), lower, upper.  Rows without time, status or stratum are left
    out.  Where surv is 0, std_err and the limits are NULL.
    """
    usable = df.dropna(subset=[time, status, *strata])
    by_time = durable(
        usable.groupBy(*strata, F.col(time).cast("double").alias("time")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(status).cast("long")).alias("n_event")
        )
    )
    ranges = count_ranges(by_time, sorted_rows)
    curve = running_totals(by_time, "time", {"n": "n_risk"}, strata, ranges, descending=True)

    d, n = F.col("n_event"), F.col("n_risk")
    curve = curve.withColumns(
        {
            # Once everybody at risk has the event the estimate is 0 and has no logarithm.
            "_log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0),
            "_end": F.when(d < n, 0).otherwise(1),
            "_var": F.when(d < n, d / (n * (n - d))).otherwise(0.0),
        }
    )
    curve = running_totals(
        curve, "time", {"_log": "_logs", "_end": "_ended", "_var": "_vars"}, strata, ranges
    )
    alive = F.col("_ended") == 0
    curve = curve.withColumns(
        {
            "surv": F.when(alive, F.exp("_logs")).otherwise(0.0),
            "surv_before": F.exp(F.col("_logs") - F.col("_log")),
            "_se": F.sqrt("_vars"),
        }
    )
    return curve.select(
        *strata,
        "time",
        "n_risk",
        "n_event",
        (F.col("n") - d).alias("n_censor"),
        "surv",
        "surv_before",
        F.when(alive, F.col("surv") * F.col("_se")).alias("std_err"),
        F.when(alive, F.exp(F.col("_logs") - Z95 * F.col("_se"))).alias("lower"),
        F.when(alive, F.least(F.lit(1.0), F.exp(F.col("_logs") + Z95 * F.col("_se")))).alias("upper"),
    )


def _crossing(y: str, level: float) -> Column:
    """First time `y` is at or below `level`; mid-point of a stretch that lies exactly on it."""
    reached = F.min(F.when(F.col(y) < level + _TOL, F.col("time")))
    value = F.min_by(y, F.when(F.col(y) < level + _TOL, F.col("time")))
    passed = F.min(F.when(F.col(y) < level - _TOL, F.col("time")))
    on_level = F.abs(value - level) < _TOL
    return F.when(on_level & passed.isNotNull(), (reached + passed) / 2).otherwise(reached)


def km_summary(
    km: DataFrame, strata: Sequence[str] = (), sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """Records, events, restricted mean with its error, median and the limits of the median."""
    drop = F.col("time") * (F.col("surv_before") - F.col("surv"))
    km = km.withColumns({"_drop": drop, "_all": F.col("n_event") + F.col("n_censor")})
    ranges = count_ranges(km, sorted_rows)
    km = running_totals(km, "time", {"_drop": "_dropped"}, strata, ranges)
    # Area under the curve from the origin to this time; to the last time it is the mean.
    origin = F.least(F.lit(0.0), F.min("time"))
    d, n = F.col("n_event"), F.col("n_risk")
    hazard = F.when(d < n, d / (n * (n - d))).otherwise(0.0)
    km = km.withColumns({"_area": F.col("_dropped") + F.col("time") * F.col("surv"), "_h": hazard})
    area = F.max_by("_area", "time")
    # Sum of (area to the right)^2 * hazard, multiplied out so that one aggregate does it.
    spread = (
        area * area * F.sum("_h")
        - 2 * area * F.sum(F.col("_h") * F.col("_area"))
        + F.sum(F.col("_h") * F.col("_area") * F.col("_area"))
    )
    return km.groupBy(*strata).agg(
        F.sum("_all").alias("records"),
        F.sum("n_event").alias("events"),
        (area - origin).alias("rmean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("rmean_se"),
        _crossing("surv", 0.5).alias("median"),
        _crossing("lower", 0.5).alias("median_lower"),
        _crossing("upper", 0.5).alias("median_upper"),
    )


def km_at(km: DataFrame, times: Sequence[float], strata: Sequence[str] = ()) -> DataFrame:
    """The estimate at given times; a time beyond the last one gives no row.

    n_risk counts those still under observation at the time, n_event all events up to it,
    n_event_since those after the previous listed time.
    """
    cells, aggs = [], []
    previous = None
    for i, t in enumerate(sorted(times)):
        upto = F.col("time") <= t
        last = F.when(upto, F.col("time"))
        since = upto if previous is None else upto & (F.col("time") > previous)
        aggs.append(
            F.struct(
                F.lit(float(t)).alias("time"),
                F.coalesce(F.max(F.when(F.col("time") >= t, F.col("n_risk"))), F.lit(0)).alias("n_risk"),
                F.coalesce(F.sum(F.when(upto, F.col("n_event"))), F.lit(0)).alias("n_event"),
                F.coalesce(F.sum(F.when(since, F.col("n_event"))), F.lit(0)).alias("n_event_since"),
                F.when(F.max(last).isNull(), 1.0).otherwise(F.max_by("surv", last)).alias("surv"),
                F.when(F.max(last).isNull(), 0.0).otherwise(F.max_by("std_err", last)).alias("std_err"),
                F.when(F.max(last).isNull(), 1.0).otherwise(F.max_by("lower", last)).alias("lower"),
                F.when(F.max(last).isNull(), 1.0).otherwise(F.max_by("upper", last)).alias("upper"),
                (F.max("time") >= t).alias("reached"),
            ).alias(f"_t{i}")
        )
        cells.append(F.col(f"_t{i}"))
        previous = t
    rows = km.groupBy(*strata).agg(*aggs).select(*strata, F.inline(F.array(*cells)))
    return rows.filter("reached").drop("reached")


def risk_table(
    df: DataFrame, time: str, breaks: Sequence[float], status: str | None = None
) -> DataFrame:
    """Number under observation at each break, absolute and in percent of all."""
    usable = df.dropna(subset=[time] + ([status] if status else []))
    counts = usable.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count(F.when(F.col(time) >= b, 1)).alias(f"_b{i}") for i, b in enumerate(breaks)],
    )
    cells = [
        F.struct(
            F.lit(float(b)).alias("time"),
            F.col(f"_b{i}").alias("n_risk"),
            (F.lit(100.0) * F.col(f"_b{i}") / F.col("_all")).alias("pct_risk"),
        )
        for i, b in enumerate(breaks)
    ]
    return counts.select(F.inline(F.array(*cells)))


def regular_breaks(df: DataFrame, time: str, step: float) -> list[float]:
    """0, step, 2*step, ... up to the longest time."""
    longest = df.agg(F.max(time)).first()[0] or 0.0
    return [i * step for i in range(int(longest // step) + 1)]


def regular_risk_table(
    df: DataFrame, time: str, step: float, strata: Sequence[str] = (), status: str | None = None
) -> DataFrame:
    """`risk_table` at 0, step, 2 * step, ... up to the longest time of all, for each stratum.

    Columns: strata, time, n_risk, pct_risk (of the stratum).  Each row is counted in the last step it
    reaches, and steps are totalled from the longest time down.  Rows without time, status or stratum are left
    out; times below 0 count for the percentage only.
    """
    usable = df.dropna(subset=[time, *strata] + ([status] if status else []))
    t, guess = F.col(time).cast("double"), F.floor(F.col(time) / F.lit(float(step)))
    # The quotient may be rounded across a break that the time itself does not cross.
    place = F.when((guess + 1) * step <= t, guess + 1).when(guess * step > t, guess - 1).otherwise(guess)
    counts = durable(usable.groupBy(*strata, place.alias("_place")).agg(F.count(F.lit(1)).alias("_n")))
    last = F.greatest(counts.agg(F.max("_place")).scalar(), F.lit(0))
    totals = counts.groupBy(*strata).agg(F.sum("_n").alias("_all")).filter("_all > 0")
    grid = totals.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cells = grid.join(counts, [*strata, "_place"], "left").na.fill(0, ["_n"])
    cells = running_totals(cells, "_place", {"_n": "n_risk"}, strata, descending=True)
    percent = F.lit(100.0) * F.col("n_risk") / F.col("_all")
    return cells.select(*strata, (F.col("_place") * F.lit(float(step))).alias("time"), "n_risk", percent.alias("pct_risk"))


def km_curve(km: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Points of a step plot: (kind, time, surv, lower, upper).

    `step` rows are the curve, with its start at (0, 1); `guide` rows are the corners of the
    median lines: (0, 0.5), (median, 0.5), (median, 0).
    """
    steps = km.select(
        *strata, F.lit("step").alias("kind"), "time", "surv", "lower", "upper"
    )
    start = F.struct(
        F.lit("step").alias("kind"),
        F.lit(0.0).alias("time"),
        F.lit(1.0).alias("surv"),
        F.lit(1.0).alias("lower"),
        F.lit(1.0).alias("upper"),
    )

    def guide(time: Column, surv: float) -> Column:
        return F.struct(
            F.lit("guide").alias("kind"),
            time.alias("time"),
            F.lit(surv).alias("surv"),
            F.lit(None).cast("double").alias("lower"),
            F.lit(None).cast("double").alias("upper"),
        )

    median = F.col("_median")
    extra = (
        km.groupBy(*strata)
        .agg(_crossing("surv", 0.5).alias("_median"))
        .select(
            *strata,
            F.inline(
                F.when(
                    median.isNotNull(),
                    F.array(start, guide(F.lit(0.0), 0.5), guide(median, 0.5), guide(median, 0.0)),
                ).otherwise(F.array(start))
            ),
        )
    )
    return steps.unionByName(extra)
