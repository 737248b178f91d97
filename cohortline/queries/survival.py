"""Kaplan-Meier on customers: first order to last order, event if the last order has status F."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import survival as sv
from ..plans import dictionaries as d
from ..plans.bindings import patients, table
from .base import query, rounded, with_patients


def months(spark, sf):
    """Customers with survival months and the covariates of `customer`."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    people = patients(spark, sf)
    time = dates.survival_time(F.col("start_date"), F.col("end_date"))
    joined = people.join(customer, people["hosp_id"] == customer["c_custkey"], "left")
    return joined.withColumn("months", time).drop("c_custkey")


def _months(spark, sf):
    time = dates.survival_time(F.col("start_date"), F.col("end_date"))
    return patients(spark, sf).select(time.alias("months"), "status")


def km_sql(source: str = "pat", time: str = "months", status: str = "status", strata: str = "") -> str:
    """CTE `km` of the estimate, by multiplication rather than logarithms."""
    by = f"PARTITION BY {strata} " if strata else ""
    lead = f"{strata}, " if strata else ""
    return f"""by_time AS (SELECT {lead}{time} AS time, count(*) AS n, CAST(sum({status}) AS BIGINT) AS d
 FROM {source} WHERE {time} IS NOT NULL AND {status} IS NOT NULL GROUP BY ALL),
risk AS (SELECT *, CAST(sum(n) OVER ({by}ORDER BY time DESC) AS BIGINT) AS n_risk FROM by_time),
steps AS (SELECT *, product(1 - d / n_risk) OVER ({by}ORDER BY time) AS surv,
  sum(CASE WHEN d < n_risk THEN d / (n_risk * (n_risk - d)) ELSE 0 END) OVER ({by}ORDER BY time) AS v FROM risk),
km AS (SELECT {lead}time, n_risk, d AS n_event, n - d AS n_censor, surv,
  CASE WHEN surv > 0 THEN surv * sqrt(v) END AS std_err,
  CASE WHEN surv > 0 THEN exp(ln(surv) - 1.959963984540054 * sqrt(v)) END AS lower,
  CASE WHEN surv > 0 THEN least(1, exp(ln(surv) + 1.959963984540054 * sqrt(v))) END AS upper,
  d / (n_risk * CASE WHEN n_risk > d THEN n_risk - d END) AS h FROM steps)"""


_KM = ", " + km_sql()


@query(
    "km_orders",
    with_patients(f"{_KM}\nSELECT time, n_risk, n_event, n_censor, round(surv, 6) AS surv FROM km"),
)
def km_orders(spark, sf):
    km = sv.kaplan_meier(_months(spark, sf), "months", "status")
    return rounded(km.select("time", "n_risk", "n_event", "n_censor", "surv"), "surv")


@query(
    "km_by_segment",
    with_patients(
        ", "
        + km_sql(strata="c_mktsegment")
        + "\nSELECT c_mktsegment, time, n_risk, n_event, n_censor, round(surv, 6) AS surv FROM km"
        + " WHERE c_mktsegment IS NOT NULL"
    ),
)
def km_by_segment(spark, sf):
    km = sv.kaplan_meier(months(spark, sf), "months", "status", ["c_mktsegment"])
    return rounded(km.select("c_mktsegment", "time", "n_risk", "n_event", "n_censor", "surv"), "surv")


@query(
    "km_confidence",
    with_patients(f"""{_KM}
SELECT time, round(surv, 6) AS surv, round(std_err, 6) AS std_err, round(lower, 6) AS lower, round(upper, 6) AS upper
FROM km"""),
)
def km_confidence(spark, sf):
    km = sv.kaplan_meier(_months(spark, sf), "months", "status")
    return rounded(km.select("time", "surv", "std_err", "lower", "upper"), "surv", "std_err", "lower", "upper")


def _cross(col: str) -> str:
    first = f"min(CASE WHEN {col} < 0.5 + 1e-8 THEN time END)"
    on = f"bool_or(abs({col} - 0.5) < 1e-8)"
    nxt = f"min(CASE WHEN {col} < 0.5 - 1e-8 THEN time END)"
    return f"CASE WHEN coalesce({on}, false) AND {nxt} IS NOT NULL THEN ({first} + {nxt}) / 2 ELSE {first} END"


SUMMARY_SQL = f"""pieces AS (SELECT *, surv * (lead(time) OVER (ORDER BY time) - time) AS area FROM km),
rights AS (SELECT *, coalesce(sum(area) OVER (ORDER BY time DESC), 0) AS area_right FROM pieces)
SELECT CAST(sum(n_event + n_censor) AS BIGINT) AS records, CAST(sum(n_event) AS BIGINT) AS events,
 round(min(time) - least(0, min(time)) + sum(area), 6) AS rmean,
 round(sqrt(sum(area_right * area_right * coalesce(h, 0))), 6) AS rmean_se,
 {_cross("surv")} AS median, {_cross("lower")} AS median_lower, {_cross("upper")} AS median_upper FROM rights"""


@query("km_median", with_patients(f"{_KM}, {SUMMARY_SQL}"))
def km_median(spark, sf):
    km = sv.kaplan_meier(_months(spark, sf), "months", "status")
    return rounded(sv.km_summary(km), "rmean", "rmean_se")


_TIMES = [-1.0, 12.0, d.REPORT_MONTHS, 60.0, 500.0]


def at_sql(times) -> str:
    """The estimate at times, from CTE `km`."""
    values = ", ".join(f"({float(t)}, {float(p)})" for t, p in zip(times, [-1e9, *times]))
    return f"""SELECT CAST(q.t AS DOUBLE) AS time,
 coalesce(max(CASE WHEN time >= q.t THEN n_risk END), 0) AS n_risk,
 CAST(coalesce(sum(CASE WHEN time <= q.t THEN n_event END), 0) AS BIGINT) AS n_event,
 CAST(coalesce(sum(CASE WHEN time <= q.t AND time > q.p THEN n_event END), 0) AS BIGINT) AS n_event_since,
 round(coalesce(min(CASE WHEN time <= q.t THEN surv END), 1), 6) AS surv,
 round(coalesce(arg_max(std_err, time) FILTER (WHERE time <= q.t), 0), 6) AS std_err,
 round(coalesce(arg_max(lower, time) FILTER (WHERE time <= q.t), 1), 6) AS lower,
 round(coalesce(arg_max(upper, time) FILTER (WHERE time <= q.t), 1), 6) AS upper
FROM km, (VALUES {values}) q(t, p) GROUP BY q.t, q.p HAVING max(time) >= q.t"""


@query("km_at_times", with_patients(f"{_KM}\n{at_sql(_TIMES)}"))
def km_at_times(spark, sf):
    km = sv.kaplan_meier(_months(spark, sf), "months", "status")
    return rounded(sv.km_at(km, _TIMES), "surv", "std_err", "lower", "upper")


_BREAKS = [float(b) for b in range(0, 96, 12)]


@query(
    "risk_table",
    with_patients(
        f"""SELECT CAST(b AS DOUBLE) AS time, count(CASE WHEN months >= b THEN 1 END) AS n_risk,
 round(100.0 * count(CASE WHEN months >= b THEN 1 END) / count(*), 6) AS pct_risk
FROM pat, (SELECT unnest({_BREAKS}) AS b) WHERE months IS NOT NULL AND status IS NOT NULL GROUP BY b"""
    ),
)
def risk_table(spark, sf):
    return rounded(sv.risk_table(_months(spark, sf), "months", _BREAKS, "status"), "pct_risk")


@query(
    "risk_table_regular",
    with_patients(
        """, used AS (SELECT c_mktsegment, months FROM pat WHERE months IS NOT NULL AND status IS NOT NULL AND c_mktsegment IS NOT NULL),
grid AS (SELECT unnest(generate_series(0, CAST(floor(greatest(max(months), 0) / 6) AS BIGINT))) * 6 AS b FROM used)
SELECT c_mktsegment, CAST(b AS DOUBLE) AS time, count(CASE WHEN months >= b THEN 1 END) AS n_risk,
 round(100.0 * count(CASE WHEN months >= b THEN 1 END) / count(*), 6) AS pct_risk
FROM used, grid GROUP BY c_mktsegment, b"""
    ),
)
def risk_table_regular(spark, sf):
    return rounded(sv.regular_risk_table(months(spark, sf), "months", 6, ["c_mktsegment"], "status"), "pct_risk")


@query(
    "km_curve",
    with_patients(f"""{_KM}, med AS (SELECT {_cross("surv")} AS m FROM km)
SELECT 'step' AS kind, time, round(surv, 6) AS surv, round(lower, 6) AS lower, round(upper, 6) AS upper FROM km
UNION ALL SELECT 'step', 0, 1, 1, 1
UNION ALL SELECT 'guide', 0, 0.5, NULL, NULL FROM med WHERE m IS NOT NULL
UNION ALL SELECT 'guide', m, 0.5, NULL, NULL FROM med WHERE m IS NOT NULL
UNION ALL SELECT 'guide', m, 0, NULL, NULL FROM med WHERE m IS NOT NULL"""),
)
def km_curve(spark, sf):
    km = sv.kaplan_meier(_months(spark, sf), "months", "status")
    return rounded(sv.km_curve(km), "surv", "lower", "upper")
