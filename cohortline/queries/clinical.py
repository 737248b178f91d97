"""The registry configuration run over `orders` as a registry export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cox as cx, describe as ds, survival as sv
from ..plans import clinical as cl, dictionaries as d
from ..plans.bindings import REGISTRY_COHORT, REGISTRY_CORRECTIONS, registry_rows
from . import cox_sql
from .base import (
    query, rounded, sql_cascade, sql_flag, sql_label, sql_recode, sql_sequential, with_registry,
)
from .survival import SUMMARY_SQL, at_sql, km_sql

_KEY, _DATE = next(iter(REGISTRY_CORRECTIONS.items()))
_DATE = str(_DATE)
_LO, _HI = REGISTRY_COHORT
_ORDER = "PARTITION BY hosp_id ORDER BY e_date NULLS LAST, ingest_id"

_FILLED = f"""f1 AS (SELECT * REPLACE (
  coalesce(iv_date, min(e_date) OVER (PARTITION BY hosp_id)) AS iv_date,
  coalesce(dx_date, min(dx_date) OVER (PARTITION BY hosp_id)) AS dx_date),
  make_date(birth_year, 1, 1) AS birth_date FROM reg),
filled AS (SELECT * REPLACE (CASE WHEN hosp_id IS NULL THEN NULL WHEN hosp_id = {_KEY} THEN DATE '{_DATE}'
  ELSE dx_date END AS dx_date) FROM f1)"""

_CLEAN = f"""{_FILLED},
harmonised AS (SELECT * REPLACE (
  CASE WHEN dx_date IS NOT NULL THEN min(dx_date) OVER (PARTITION BY hosp_id) END AS dx_date) FROM filled),
clean AS (SELECT * EXCLUDE (birth_year) REPLACE (coalesce(encounter_type, 'Return') AS encounter_type) FROM harmonised
 WHERE dx_date BETWEEN DATE '{_LO}' AND DATE '{_HI}'
 QUALIFY row_number() OVER (PARTITION BY hosp_id, pat_name, e_date ORDER BY ingest_id) = 1)"""


def _gap(col: str, days: int) -> str:
    return f"""CASE WHEN encounter_type = 'Initial' AND {col} IS NULL
  AND date_diff('day', lag(e_date) OVER ({_ORDER}), e_date) < {days} THEN lead({col}) OVER ({_ORDER}) ELSE {col} END"""


_REGIMENS = ("regimen_start", "regimen_cont", "regimen_chemo")
_PLAN = sql_recode(f"({sql_recode('remission_plan', d.REMISSION_CODES)})", d.REMISSION_PLANS)
_STEP1 = {
    "outcome": sql_recode("outcome", d.OUTCOMES),
    "complaint": sql_sequential("complaint", d.COMPLAINT_CODES),
    "pain_site": sql_sequential("pain_site", d.PAIN_CODES),
    "signs": sql_sequential("signs", d.SIGN_CODES),
    "bleeding_site": sql_recode("bleeding_site", d.BLEEDING_SITES),
    "swelling_site": sql_recode("swelling_site", d.SWELLING_SITES),
    **{c: sql_recode(c, d.REGIMENS) for c in _REGIMENS},
    "remission_plan": sql_cascade(_PLAN, "notes", [(d.MAINTENANCE_NOTES, d.MAINTENANCE)], "(?is)"),
    "on_remission": "CASE WHEN on_remission IS NULL THEN NULL"
    " WHEN NOT on_remission AND remission_date IS NOT NULL THEN true ELSE on_remission END",
}
_NEW1 = {
    "record_count": f"row_number() OVER ({_ORDER})",
    "latest_encounter": "coalesce(death_date, max(e_date) OVER (PARTITION BY hosp_id))",
    "age": "CAST(date_sub('year', birth_date, dx_date) AS INT)",
    "creatinine": _gap("creatinine_raw", d.CREATININE_GAP),
    "spep": _gap("m_component", d.M_COMPONENT_GAP),
    "corrected_calcium": "CASE WHEN albumin IS NULL THEN NULL WHEN albumin < 40 THEN calcium + 0.02 * (40 - albumin)"
    " WHEN albumin > 45 THEN calcium - 0.02 * (albumin - 45) ELSE calcium END",
    "ecog_label": sql_label("ecog_index", d.ECOG),
    "cycle": "coalesce(cycle_start, cycle_cont, cycle_chemo)",
}
_NEW2 = {
    "survival_status": "CASE WHEN outcome IS NULL THEN NULL WHEN outcome IN ('Alive', 'LTFU') THEN 0 ELSE 1 END",
    "renal_failure": "CASE WHEN creatinine > 177 THEN '> 177' WHEN creatinine <= 177 THEN '<=177' END",
    "anemia": "CASE WHEN hgb < 10 THEN '< 10' WHEN hgb >= 10 THEN '>=10' END",
    "hypercalcemia": "CASE WHEN corrected_calcium > 2.75 THEN 'Yes' WHEN corrected_calcium <= 2.75 THEN 'No' END",
    **{n: sql_flag("complaint", p) for n, p in d.COMPLAINT_FLAGS.items()},
    **{n: sql_flag("pain_site", p) for n, p in d.PAIN_FLAGS.items()},
    **{n: sql_flag("signs", p) for n, p in d.SIGN_FLAGS.items()},
    "treatment": sql_cascade(f"coalesce({', '.join(_REGIMENS)})", "notes", d.NOTE_RULES),
}
_BY_PLAN = """CASE WHEN on_remission THEN true
 WHEN NOT on_remission AND remission_plan IS NOT NULL THEN true END"""
_DERIVED = f"""{_CLEAN},
d1 AS (SELECT * REPLACE ({", ".join(f"{e} AS {n}" for n, e in _STEP1.items())}),
 {", ".join(f"{e} AS {n}" for n, e in _NEW1.items())} FROM clean),
derived AS (SELECT * REPLACE ({_BY_PLAN} AS on_remission),
 {", ".join(f"{e} AS {n}" for n, e in _NEW2.items())} FROM d1)"""
_INITIAL = f"""{_DERIVED},
init AS (SELECT *, CAST(date_diff('day', dx_date, latest_encounter) AS DOUBLE) AS survival_days,
 CAST(round(date_diff('day', dx_date, latest_encounter) / 30.5, 1) AS DOUBLE) AS survival_months,
 CAST(round(date_diff('day', dx_date, latest_encounter) / 365.25, 1) AS DOUBLE) AS survival_years,
 CASE WHEN outcome IN ('Alive', 'LTFU') THEN 'censored' ELSE 'Deceased' END AS survival_censor
 FROM derived WHERE encounter_type = 'Initial')"""


def _sql(ctes: str, select: str) -> str:
    return with_registry(f", {ctes}\n{select}")


def _filled(spark, sf):
    return cl.fill_dates(registry_rows(spark, sf), REGISTRY_CORRECTIONS)


def _derived(spark, sf):
    return cl.registry(registry_rows(spark, sf), REGISTRY_CORRECTIONS, REGISTRY_COHORT)


def _initial(spark, sf):
    return cl.initial_visits(_derived(spark, sf))


@query(
    "registry_conflicts",
    _sql(
        _FILLED,
        """SELECT hosp_id FROM filled GROUP BY hosp_id
HAVING count(DISTINCT dx_date) + max(CAST(dx_date IS NULL AS INT)) > 1""",
    ),
)
def registry_conflicts(spark, sf):
    return cl.diagnosis_conflicts(_filled(spark, sf))


@query(
    "registry_clean",
    _sql(_CLEAN, "SELECT ingest_id, hosp_id, pat_name, e_date, iv_date, dx_date, birth_date, encounter_type FROM clean"),
)
def registry_clean(spark, sf):
    return cl.clean(_filled(spark, sf), REGISTRY_COHORT).select(
        "ingest_id", "hosp_id", "pat_name", "e_date", "iv_date", "dx_date", "birth_date", "encounter_type"
    )


_CLEAN_COLUMNS = ["ingest_id", "hosp_id", "pat_name", "e_date", "iv_date", "dx_date", "birth_date", "encounter_type"]


@query("registry_clean_intent", _sql(_CLEAN.replace("hosp_id, pat_name, e_date ORDER", "hosp_id, e_date ORDER"), f"SELECT {', '.join(_CLEAN_COLUMNS)} FROM clean"))
def registry_clean_intent(spark, sf):
    return cl.clean(_filled(spark, sf), REGISTRY_COHORT, intent=True).select(*_CLEAN_COLUMNS)


@query(
    "registry_encounters",
    _sql(_DERIVED, "SELECT * REPLACE (round(corrected_calcium, 6) AS corrected_calcium) FROM derived"),
)
def registry_encounters(spark, sf):
    return rounded(_derived(spark, sf), "corrected_calcium")


@query(
    "registry_initial",
    _sql(_INITIAL, "SELECT * REPLACE (round(corrected_calcium, 6) AS corrected_calcium) FROM init"),
)
def registry_initial(spark, sf):
    return rounded(_initial(spark, sf), "corrected_calcium")


_FREQ = [
    "survival_status", *cl.COMPLAINTS, *cl.PAINS, *cl.SIGNS, "bleeding_site", "ecog_index", *_REGIMENS,
    "treatment", "cycle", "remission_plan", "on_remission",
]


@query(
    "registry_frequencies",
    _sql(
        _DERIVED,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM derived"
            f" WHERE {c} IS NOT NULL GROUP BY 2"
            for c in _FREQ
        ),
    ),
)
def registry_frequencies(spark, sf):
    return cl.frequency_tables(_derived(spark, sf))


@query(
    "registry_survival_frequencies",
    _sql(
        _INITIAL,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST({c} + 0.0 AS VARCHAR) AS value, count(*) AS n FROM init WHERE {c} IS NOT NULL GROUP BY 2"
            for c in ("survival_days", "survival_months", "survival_years")
        ),
    ),
)
def registry_survival_frequencies(spark, sf):
    return cl.survival_frequency_tables(_initial(spark, sf))


@query(
    "registry_initial_intent",
    _sql(
        _INITIAL,
        """SELECT ingest_id, hosp_id, record_count, survival_months FROM init
QUALIFY record_count = min(record_count) OVER (PARTITION BY hosp_id)""",
    ),
)
def registry_initial_intent(spark, sf):
    """One initial row for a patient."""
    return cl.initial_visits(_derived(spark, sf), intent=True).select("ingest_id", "hosp_id", "record_count", "survival_months")


@query(
    "registry_ecog_frequencies",
    _sql(_DERIVED, "SELECT ecog_label AS value, count(*) AS n FROM derived WHERE ecog_label IS NOT NULL GROUP BY 1"),
)
def registry_ecog_frequencies(spark, sf):
    """The table of the labelled index, which the specified name of the column misses."""
    return ds.freq(_derived(spark, sf), "ecog_label")


_CRAB = ["renal_failure", "anemia", "hypercalcemia"]


@query(
    "registry_crosstabs",
    _sql(
        _DERIVED,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS indicator, a.r AS "row", b.c AS "column",
 (SELECT count(*) FROM derived WHERE encounter_type = a.r AND {c} = b.c) AS n
FROM (SELECT DISTINCT encounter_type AS r FROM derived WHERE {c} IS NOT NULL) a,
 (SELECT DISTINCT {c} AS c FROM derived WHERE {c} IS NOT NULL) b"""
            for c in _CRAB
        ),
    ),
)
def registry_crosstabs(spark, sf):
    levels = {"renal_failure": ["<=177", "> 177"], "anemia": ["< 10", ">=10"], "hypercalcemia": ["No", "Yes"]}
    return ds.crosstabs(_derived(spark, sf), "encounter_type", levels)


_KM = f"{_INITIAL}, {km_sql('init', 'survival_months', 'survival_status')}"


@query(
    "registry_km",
    _sql(
        _KM,
        """SELECT time, n_risk, n_event, n_censor, round(surv, 6) AS surv, round(std_err, 6) AS std_err,
 round(lower, 6) AS lower, round(upper, 6) AS upper FROM km""",
    ),
)
def registry_km(spark, sf):
    km = cl.survival_curve(_initial(spark, sf)).drop("surv_before")
    return rounded(km, "surv", "std_err", "lower", "upper")


@query("registry_km_summary", _sql(f"{_KM}, {SUMMARY_SQL}", ""))
def registry_km_summary(spark, sf):
    return rounded(sv.km_summary(cl.survival_curve(_initial(spark, sf))), "rmean", "rmean_se")


@query("registry_km_at", _sql(_KM, at_sql([d.REPORT_MONTHS])))
def registry_km_at(spark, sf):
    at = sv.km_at(cl.survival_curve(_initial(spark, sf)), [d.REPORT_MONTHS])
    return rounded(at, "surv", "std_err", "lower", "upper")


_COLUMNS = ["term", "coef", "exp_coef", "se", "z", "p", "lower", "upper"]
_TESTS = ["loglik0", "loglik", "lrt", "lrt_p", "wald", "wald_p", "score", "score_p", "concordance"]
_CLOCK = ("survival_months", "survival_status")
_INITIAL_ONCE = _INITIAL.replace("\ninit AS (", "\ninit AS MATERIALIZED (")


def _settled(df, *cols):
    """Estimates of a fit that has not settled are not comparable, so the queries don't show them."""
    return df.withColumns({c: F.when(F.col("converged"), F.col(c)) for c in cols})


def _table(df, *first):
    shown = _settled(df.select(*first, *_COLUMNS, "n", "n_event", "converged"), *_COLUMNS[1:])
    return rounded(shown, *_COLUMNS[1:])


def _tests(df, *first):
    shown = _settled(df.select(*first, "n", "n_event", "df", *_TESTS, "converged"), "loglik", "lrt", "lrt_p", "wald", "wald_p", "concordance")
    return rounded(shown, *_TESTS)


_ALL_FITS = ", ".join([_INITIAL_ONCE, *[cox_sql.fit_sql(n, "init", *_CLOCK, m) for n, m in cl.MODELS.items()]])
_JOINT_FIT = f"{_INITIAL_ONCE}, {cox_sql.fit_sql('joint', 'init', *_CLOCK, cl.JOINT_MODEL)}"


@query(
    "registry_cox_models",
    _sql(_ALL_FITS, " UNION ALL ".join(cox_sql.summary_sql(n, first=f"'{n}' AS model, ") for n in cl.MODELS)),
)
def registry_cox_models(spark, sf):
    initial = _initial(spark, sf)
    return _table(cx.cox_table(cl.cox_models(initial)), "model")


@query(
    "registry_cox_model_tests",
    _sql(
        ", ".join([_ALL_FITS, *[cox_sql.tests_ctes(n) for n in cl.MODELS]]),
        " UNION ALL ".join(cox_sql.tests_select(n, first=f"'{n}' AS model, ") for n in cl.MODELS),
    ),
)
def registry_cox_model_tests(spark, sf):
    return _tests(cx.cox_tests_all(cl.cox_models(_initial(spark, sf))), "model")


@query("registry_cox_joint", _sql(_JOINT_FIT, cox_sql.summary_sql("joint", first="'joint' AS model, ")))
def registry_cox_joint(spark, sf):
    fit = cl.joint_cox(_initial(spark, sf))
    return _table(cx.cox_table({"joint": fit}), "model")


@query("registry_cox_joint_tests", _sql(f"{_JOINT_FIT}, {cox_sql.tests_ctes('joint')}", cox_sql.tests_select("joint")))
def registry_cox_joint_tests(spark, sf):
    return _tests(cx.cox_tests(cl.joint_cox(_initial(spark, sf))))


@query("registry_cox_joint_zph", _sql(f"{_JOINT_FIT}, {cox_sql.zph_sql('joint', cl.JOINT_MODEL)}", ""))
def registry_cox_joint_zph(spark, sf):
    fit = cl.joint_cox(_initial(spark, sf))
    shown = _settled(cx.cox_zph(fit).withColumn("converged", F.lit(fit.converged)), "chisq", "p").drop("converged")
    return rounded(shown, "chisq", "p")
