"""The myeloma registry: raw encounters -> clean -> derived -> initial visits -> statistics.

Input is one row per encounter with the names of `dictionaries.RENAME` (typed) and `ingest_id`.
Every stage is a DataFrame; `clean` ends in a durable copy, because the stage after it reads
its input several times.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clinical as c, dates, text
from ..operators import describe, frames, longitudinal as lg, quality, survival
from ..operators.cox import Covariate, CoxFit, coxph, coxph_all
from ..operators.durable import durable
from ..operators.skew import HOT_ROWS, hot_keys, with_group_values, with_neighbours
from ..sources.encounters import read_encounters
from . import dictionaries as d

DATE_COLUMNS = ["e_date", "iv_date", "death_date", "dx_date"]
NUMBERS = ["creatinine_raw", "hgb", "albumin", "calcium", "m_component"]
REGIMEN_COLUMNS = ["regimen_start", "regimen_cont", "regimen_chemo"]
COMPLAINTS = list(d.COMPLAINT_FLAGS)
PAINS = list(d.PAIN_FLAGS)
SIGNS = list(d.SIGN_FLAGS)


def read_registry(spark: SparkSession, path, columns: Sequence[str]) -> DataFrame:
    """The registry's CSV export, typed."""
    casts = {name: dates.parse_date(F.col(name)) for name in DATE_COLUMNS}
    casts |= {name: "double" for name in NUMBERS}
    casts |= {"hosp_id": "bigint", "birth_year": "int", "ecog_index": "int", "on_remission": "boolean"}
    return read_encounters(spark, path, columns, d.RENAME, casts)


def fill_dates(
    raw: DataFrame, corrections: Mapping | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Fill first-visit and diagnosis dates from the patient's other rows, then correct by key.

    One window gives all three per-patient dates that the later steps use as well.
    """
    known = with_group_values(
        raw,
        ["hosp_id"],
        {
            "_first_seen": F.min("e_date"),
            "_first_dx": F.min("dx_date"),
            "latest_encounter": F.max("e_date"),
        },
        hot_rows=hot_rows,
    )
    filled = known.withColumns(
        {
            "birth_date": dates.date_from_year(F.col("birth_year")),
            "iv_date": F.coalesce("iv_date", "_first_seen"),
            "dx_date": F.coalesce("dx_date", "_first_dx"),
        }
    )
    for col in ("dx_date", "_first_dx"):
        filled = frames.apply_corrections(filled, "hosp_id", col, corrections or {})
    return filled.drop("_first_seen")


def clean(
    filled: DataFrame, cohort: tuple = d.COHORT, drop: Sequence[str] = ("birth_year",), intent: bool = False
) -> DataFrame:
    """Harmonise diagnosis dates, take the cohort, drop columns, type missing encounters, dedup.

    As specified two rows of a patient and day are both kept if the name is spelled differently; `intent=True` keeps one.

    A corrected patient has one date on all rows, any other patient's earliest is known from
    `fill_dates`, so harmonising needs no second pass over the patient's rows.
    """
    dx = F.when(F.col("dx_date").isNotNull(), F.col("_first_dx"))
    table = filled.withColumn("dx_date", dx).drop("_first_dx")
    table = frames.cohort(table, "dx_date", *[F.lit(x).cast("date") for x in cohort])
    table = frames.drop_strict(table, drop)
    table = frames.fill_constant(table, "encounter_type", "Return")
    names = [] if intent else ["pat_name"]
    return durable(lg.dedup_keep_first(table, ["hosp_id", *names, "e_date"]))


def derive(clean: DataFrame, intent: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All indicators, recoded fields and flags."""
    hot = hot_keys(clean, ["hosp_id"], hot_rows)
    placed = with_neighbours(
        clean, "hosp_id", "e_date", "ingest_id", ["creatinine_raw", "m_component"], hot, hot_rows
    )
    initial = F.col("encounter_type") == "Initial"
    gap = {"wanted": initial, "date": "e_date", "intent": intent}
    recoded = {
        "outcome": text.recode_exact("outcome", d.OUTCOMES),
        "complaint": _decode("complaint", d.COMPLAINT_CODES, intent),
        "pain_site": _decode("pain_site", d.PAIN_CODES, intent),
        "signs": _decode("signs", d.SIGN_CODES, intent),
        "bleeding_site": text.recode_exact("bleeding_site", d.BLEEDING_SITES),
        "swelling_site": text.recode_exact("swelling_site", d.SWELLING_SITES),
        "ecog_label": text.ordered_label("ecog_index", d.ECOG),
        **{r: text.recode_exact(r, d.REGIMENS) for r in REGIMEN_COLUMNS},
        "cycle": text.first_present("cycle_start", "cycle_cont", "cycle_chemo"),
        "remission_plan": text.recode_exact(
            text.recode_exact("remission_plan", d.REMISSION_CODES), d.REMISSION_PLANS
        ),
    }
    placed = placed.withColumns(
        {
            "record_count": F.col("_ordinal"),
            "latest_encounter": F.coalesce("death_date", "latest_encounter"),
            "age": dates.whole_years(F.col("birth_date"), F.col("dx_date")),
            "creatinine": lg.lead_fill("creatinine_raw", max_gap=d.CREATININE_GAP, **gap),
            "spep": lg.lead_fill("m_component", max_gap=d.M_COMPONENT_GAP, **gap),
            "corrected_calcium": c.corrected_calcium(F.col("calcium"), F.col("albumin")),
            "on_remission": c.remission_by_date(F.col("on_remission"), F.col("remission_date")),
            **{name: F.expr(sql) for name, sql in recoded.items()},
        }
    ).drop("_ordinal", "_prev_date", "_next")

    flags = {
        "complaint": d.COMPLAINT_FLAGS,
        "pain_site": d.PAIN_FLAGS_INTENT if intent else d.PAIN_FLAGS,
        "signs": d.SIGN_FLAGS,
    }
    maintenance = [(d.MAINTENANCE_NOTES_INTENT if intent else d.MAINTENANCE_NOTES, d.MAINTENANCE)]
    found = {
        **{name: text.keyword_flag(col, p) for col, patterns in flags.items() for name, p in patterns.items()},
        "treatment": text.rule_cascade(text.first_present(*REGIMEN_COLUMNS), "notes", d.NOTE_RULES),
        "remission_plan": text.rule_cascade("remission_plan", "notes", maintenance, ignore_case=True),
    }
    derived = placed.withColumns(
        {
            "survival_status": c.event_flag(F.col("outcome"), d.CENSORED),
            "renal_failure": c.band(F.col("creatinine"), d.CREATININE_CUT, "<=177", "> 177", True),
            "anemia": c.band(F.col("hgb"), d.HGB_CUT, "< 10", ">=10", False),
            "hypercalcemia": c.yes_no(F.col("corrected_calcium") > d.CALCIUM_CUT),
            **{name: F.expr(sql) for name, sql in found.items()},
        }
    )
    derived = derived.withColumn(
        "on_remission",
        c.remission_by_plan(F.col("on_remission"), F.col("remission_plan"), d.STOP_PLAN, intent),
    )
    return frames.reorder(derived, d.FRONT_COLUMNS)


def _decode(col: str, codes, intent: bool) -> str:
    return text.recode_tokens(col, dict(codes)) if intent else text.recode_sequential(col, codes)


def initial_visits(derived: DataFrame, intent: bool = False) -> DataFrame:
    """Rows of initial encounters with survival times and the censoring label.

    As specified a patient with two initial rows counts twice; `intent=True` keeps the first.
    """
    rows = frames.keep_label(derived, "encounter_type", "Initial")
    if intent:
        first = rows.groupBy(F.col("hosp_id").alias("_id")).agg(F.min("record_count").alias("_first"))
        same = F.col("hosp_id").eqNullSafe(F.col("_id")) & F.col("record_count").eqNullSafe(F.col("_first"))
        rows = rows.join(first, same, "left_semi")
    start, end = F.col("dx_date"), F.col("latest_encounter")
    return rows.withColumns(
        {
            "survival_days": dates.survival_time(start, end, "days"),
            "survival_months": dates.survival_time(start, end, "months"),
            "survival_years": dates.survival_time(start, end, "years"),
            "survival_censor": c.censor_label(F.col("outcome"), d.CENSORED, intent=intent),
        }
    )


def registry(
    raw: DataFrame,
    corrections: Mapping | None = None,
    cohort: tuple = d.COHORT,
    drop: Sequence[str] = ("birth_year",),
    intent: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All stages up to the derived encounter table."""
    return derive(clean(fill_dates(raw, corrections, hot_rows), cohort, drop, intent), intent, hot_rows)


def diagnosis_conflicts(filled: DataFrame) -> DataFrame:
    """Patients whose rows still carry different diagnosis dates: the review list."""
    return quality.keys_conflicting(filled, "hosp_id", "dx_date")


def frequency_tables(derived: DataFrame) -> DataFrame:
    """All one-way frequency tables of the analysis in one pass."""
    cols = [
        "survival_status", *COMPLAINTS, *PAINS, *SIGNS, "bleeding_site", "ecog_index", "regimen_start",
        "regimen_cont", "regimen_chemo", "treatment", "cycle", "remission_plan", "on_remission",
    ]
    return describe.freq_many(derived, cols)


def survival_frequency_tables(initial: DataFrame) -> DataFrame:
    """The frequency tables of survival in days, months and years."""
    return describe.freq_many(initial, ["survival_days", "survival_months", "survival_years"])


MODELS = {
    "ecog": [Covariate("ecog_label", "category", "Normal", tuple(d.ECOG.values()))],
    "bone_pain": [Covariate("bone_pain", "category")],
    "creatinine": [Covariate("creatinine")],
    "treatment": [Covariate("treatment", "category")],
    "anemia": [Covariate("anemia", "category")],
    "renal_failure": [Covariate("renal_failure", "category")],
    "hypercalcemia": [Covariate("hypercalcemia", "category")],
}
JOINT_MODEL = [
    *MODELS["ecog"],
    *MODELS["creatinine"],
    *MODELS["treatment"],
    *MODELS["anemia"],
    *MODELS["renal_failure"],
]


def cox_models(initial: DataFrame, names: Iterable[str] = tuple(MODELS)) -> dict[str, CoxFit]:
    """The one-covariate models, all fitted at once."""
    return coxph_all(initial, "survival_months", "survival_status", {n: MODELS[n] for n in names})


def joint_cox(initial: DataFrame) -> CoxFit:
    """The model of all covariates together."""
    return coxph(initial, "survival_months", "survival_status", JOINT_MODEL)


def survival_curve(initial: DataFrame) -> DataFrame:
    """Kaplan-Meier estimate of survival in months."""
    return survival.kaplan_meier(initial, "survival_months", "survival_status")
