"""Intervals, thresholds and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as c, dates
from ..plans import dictionaries as d
from ..plans.bindings import enc, patients
from .base import query, rounded, with_enc, with_patients


@query(
    "whole_years",
    with_enc("""SELECT ingest_id, CAST(date_sub('year', make_date(birth_year, 1, 1), dx_date) AS INT) AS age
FROM enc"""),
)
def whole_years(spark, sf):
    birth = dates.date_from_year(F.col("birth_year"))
    return enc(spark, sf).select("ingest_id", dates.whole_years(birth, F.col("dx_date")).alias("age"))


@query(
    "day_gap",
    with_enc("SELECT ingest_id, CAST(date_diff('day', dx_date, e_date) AS INT) AS days FROM enc"),
)
def day_gap(spark, sf):
    return enc(spark, sf).select("ingest_id", dates.day_gap(F.col("e_date"), F.col("dx_date")).alias("days"))


@query(
    "survival_time",
    with_patients("""SELECT hosp_id,
 CAST(date_diff('day', start_date, end_date) AS DOUBLE) AS survival_days,
 months AS survival_months,
 CAST(round(date_diff('day', start_date, end_date) / 365.25, 1) AS DOUBLE) AS survival_years
FROM pat"""),
)
def survival_time(spark, sf):
    start, end = F.col("start_date"), F.col("end_date")
    return patients(spark, sf).select(
        "hosp_id",
        *[dates.survival_time(start, end, u).alias(f"survival_{u}") for u in ("days", "months", "years")],
    )


@query(
    "band",
    with_enc("""SELECT ingest_id,
 CASE WHEN creatinine_raw > 17.7 THEN '> 17.7' WHEN creatinine_raw <= 17.7 THEN '<=17.7' END AS renal_failure,
 CASE WHEN hgb < 10 THEN '< 10' WHEN hgb >= 10 THEN '>=10' END AS anemia FROM enc"""),
)
def band(spark, sf):
    return enc(spark, sf).select(
        "ingest_id",
        c.band(F.col("creatinine_raw"), 17.7, "<=17.7", "> 17.7", True).alias("renal_failure"),
        c.band(F.col("hgb"), d.HGB_CUT, "< 10", ">=10", False).alias("anemia"),
    )


_CALCIUM = """CASE WHEN albumin IS NULL THEN NULL WHEN albumin < 40 THEN calcium + 0.02 * (40 - albumin)
 WHEN albumin > 45 THEN calcium - 0.02 * (albumin - 45) ELSE calcium END"""


@query("corrected_calcium", with_enc(f"SELECT ingest_id, round({_CALCIUM}, 6) AS corrected_calcium FROM enc"))
def corrected_calcium(spark, sf):
    value = c.corrected_calcium(F.col("calcium"), F.col("albumin")).alias("corrected_calcium")
    return rounded(enc(spark, sf).select("ingest_id", value), "corrected_calcium")


@query(
    "hypercalcemia",
    with_enc(f"""SELECT ingest_id, CASE WHEN v > 2.75 THEN 'Yes' WHEN v <= 2.75 THEN 'No' END AS hypercalcemia
FROM (SELECT ingest_id, {_CALCIUM} AS v FROM enc)"""),
)
def hypercalcemia(spark, sf):
    value = c.corrected_calcium(F.col("calcium"), F.col("albumin"))
    return enc(spark, sf).select("ingest_id", c.yes_no(value > d.CALCIUM_CUT).alias("hypercalcemia"))


@query(
    "event_flag",
    with_enc("""SELECT ingest_id, CASE WHEN outcome IS NULL THEN NULL WHEN outcome IN ('Alive', 'LTFU') THEN 0
 ELSE 1 END AS survival_status FROM enc"""),
)
def event_flag(spark, sf):
    return enc(spark, sf).select(
        "ingest_id", c.event_flag(F.col("outcome"), d.CENSORED).alias("survival_status")
    )


@query(
    "censor_label",
    with_enc("""SELECT ingest_id, CASE WHEN outcome IN ('Alive', 'LTFU') THEN 'censored' ELSE 'Deceased' END
 AS survival_censor, CASE WHEN outcome IN ('Alive', 'LTFU') THEN 'censored' WHEN outcome IS NOT NULL THEN 'Deceased'
 END AS survival_censor_intent FROM enc"""),
)
def censor_label(spark, sf):
    return enc(spark, sf).select(
        "ingest_id",
        c.censor_label(F.col("outcome"), d.CENSORED).alias("survival_censor"),
        c.censor_label(F.col("outcome"), d.CENSORED, intent=True).alias("survival_censor_intent"),
    )


_BY_DATE = """CASE WHEN on_remission IS NULL THEN NULL WHEN NOT on_remission AND remission_date IS NOT NULL
 THEN true ELSE on_remission END"""


@query("flag_by_date", with_enc(f"SELECT ingest_id, {_BY_DATE} AS on_remission FROM enc"))
def flag_by_date(spark, sf):
    flag = c.remission_by_date(F.col("on_remission"), F.col("remission_date"))
    return enc(spark, sf).select("ingest_id", flag.alias("on_remission"))


@query(
    "flag_by_plan",
    with_enc("""SELECT ingest_id,
 CASE WHEN on_remission THEN true WHEN NOT on_remission AND remission_plan IS NOT NULL THEN true END AS on_remission,
 CASE WHEN on_remission IS NULL THEN NULL ELSE on_remission OR
  coalesce(remission_plan <> 'stop all medications', false) END AS on_remission_intent FROM enc"""),
)
def flag_by_plan(spark, sf):
    flag, plan = F.col("on_remission"), F.col("remission_plan")
    return enc(spark, sf).select(
        "ingest_id",
        c.remission_by_plan(flag, plan, d.STOP_PLAN).alias("on_remission"),
        c.remission_by_plan(flag, plan, d.STOP_PLAN, intent=True).alias("on_remission_intent"),
    )
