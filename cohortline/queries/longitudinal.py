"""Per-subject repair, projection and filtering."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import chain, frames, longitudinal as lg
from ..plans.bindings import ENC, enc
from .base import query, with_enc

_BY = "OVER (PARTITION BY hosp_id)"
_ORDER = "PARTITION BY hosp_id ORDER BY e_date NULLS LAST, ingest_id"


def _rows(spark, sf, *cols):
    return enc(spark, sf).select("ingest_id", "hosp_id", *cols)


@query(
    "fill_from_group_min",
    with_enc(f"SELECT ingest_id, hosp_id, e_date, coalesce(iv_date, min(e_date) {_BY}) AS iv_date FROM enc"),
)
def fill_from_group_min(spark, sf):
    return lg.fill_from_group_min(_rows(spark, sf, "e_date", "iv_date"), "hosp_id", "iv_date", "e_date")


@query(
    "fill_own_min",
    with_enc(f"SELECT ingest_id, hosp_id, coalesce(dx_date, min(dx_date) {_BY}) AS dx_date FROM enc"),
)
def fill_own_min(spark, sf):
    return lg.fill_from_group_min(_rows(spark, sf, "dx_date"), "hosp_id", "dx_date")


@query(
    "harmonise_to_min",
    with_enc(
        f"SELECT ingest_id, hosp_id, CASE WHEN dx_date IS NOT NULL THEN min(dx_date) {_BY} END AS dx_date FROM enc"
    ),
)
def harmonise_to_min(spark, sf):
    return lg.harmonise_to_min(_rows(spark, sf, "dx_date"), "hosp_id", "dx_date")


@query(
    "fill_constant",
    with_enc("SELECT ingest_id, hosp_id, coalesce(encounter_type, 'Return') AS encounter_type FROM enc"),
)
def fill_constant(spark, sf):
    return frames.fill_constant(_rows(spark, sf, "encounter_type"), "encounter_type", "Return")


@query(
    "dedup_keep_first",
    with_enc("""SELECT ingest_id, hosp_id, pat_name, e_date, iv_date, dx_date, encounter_type, notes FROM enc
QUALIFY row_number() OVER (PARTITION BY hosp_id, pat_name, e_date ORDER BY ingest_id) = 1"""),
)
def dedup_keep_first(spark, sf):
    rows = _rows(spark, sf, "pat_name", "e_date", "iv_date", "dx_date", "encounter_type", "notes")
    return lg.dedup_keep_first(rows, ["hosp_id", "pat_name", "e_date"])


@query(
    "ordinal",
    with_enc(f"SELECT ingest_id, hosp_id, e_date, row_number() OVER ({_ORDER}) AS record_count FROM enc"),
)
def ordinal(spark, sf):
    return lg.ordinal(_rows(spark, sf, "e_date"), "hosp_id", "e_date")


@query("group_count", with_enc(f"SELECT ingest_id, hosp_id, count(*) {_BY} AS n_encounters FROM enc"))
def group_count(spark, sf):
    return lg.group_count(_rows(spark, sf), "hosp_id", "n_encounters")


@query(
    "group_max",
    with_enc(f"SELECT ingest_id, hosp_id, e_date, max(e_date) {_BY} AS latest_encounter FROM enc"),
)
def group_max(spark, sf):
    return lg.group_max(_rows(spark, sf, "e_date"), "hosp_id", "e_date", "latest_encounter")


@query(
    "override_if_present",
    with_enc(f"""SELECT ingest_id, hosp_id, e_date, death_date,
 coalesce(death_date, max(e_date) {_BY}) AS latest_encounter FROM enc"""),
)
def override_if_present(spark, sf):
    rows = lg.group_max(_rows(spark, sf, "e_date", "death_date"), "hosp_id", "e_date", "latest_encounter")
    return frames.override_if_present(rows, "latest_encounter", "death_date")


def _gap_sql(col: str, gap: str, days: int, out: str) -> str:
    return with_enc(f"""SELECT ingest_id, hosp_id, e_date, encounter_type, {col},
 CASE WHEN encounter_type = 'Initial' AND {col} IS NULL AND {gap} < {days}
  THEN lead({col}) OVER ({_ORDER}) ELSE {col} END AS {out} FROM enc""")


_BACK = f"date_diff('day', lag(e_date) OVER ({_ORDER}), e_date)"
_AHEAD = f"date_diff('day', e_date, lead(e_date) OVER ({_ORDER}))"


def _gap_fill(spark, sf, col, days, out, intent=False):
    rows = _rows(spark, sf, "e_date", "encounter_type", col)
    return lg.gap_limited_lead_fill(
        rows, "hosp_id", "e_date", col, "encounter_type", "Initial", days, out, intent=intent
    )


@query("gap_fill_7", _gap_sql("creatinine_raw", _BACK, 7, "creatinine"))
def gap_fill_7(spark, sf):
    return _gap_fill(spark, sf, "creatinine_raw", 7, "creatinine")


@query("gap_fill_14", _gap_sql("m_component", _BACK, 14, "spep"))
def gap_fill_14(spark, sf):
    return _gap_fill(spark, sf, "m_component", 14, "spep")


@query("gap_fill_intent", _gap_sql("creatinine_raw", _AHEAD, 1, "creatinine"))
def gap_fill_intent(spark, sf):
    return _gap_fill(spark, sf, "creatinine_raw", 1, "creatinine", intent=True)


@query(
    "fill_from_first_returns",
    with_enc(f""", early AS (
 SELECT hosp_id, creatinine_raw, row_number() OVER ({_ORDER}) AS place FROM enc WHERE encounter_type = 'Return'),
found AS (SELECT hosp_id, arg_min(creatinine_raw, place) AS v FROM early
 WHERE place <= 4 AND creatinine_raw IS NOT NULL GROUP BY hosp_id)
SELECT ingest_id, enc.hosp_id, e_date, encounter_type, creatinine_raw,
 CASE WHEN encounter_type = 'Initial' AND creatinine_raw IS NULL THEN v ELSE creatinine_raw END AS creatinine
FROM enc LEFT JOIN found ON enc.hosp_id IS NOT DISTINCT FROM found.hosp_id"""),
)
def fill_from_first_returns(spark, sf):
    rows = _rows(spark, sf, "e_date", "encounter_type", "creatinine_raw")
    return lg.fill_from_first_returns(
        rows, "hosp_id", "e_date", "creatinine_raw", "encounter_type", "Initial", "Return", 4, "creatinine"
    )


@query(
    "drop_strict",
    with_enc("SELECT ingest_id, hosp_id, e_date, encounter_type FROM enc"),
)
def drop_strict(spark, sf):
    keep = {"ingest_id", "hosp_id", "e_date", "encounter_type"}
    return frames.drop_strict(enc(spark, sf), [c for c in ENC if c not in keep])


@query(
    "reorder",
    with_enc("SELECT iv_date, hosp_id, e_date, regimen_a, ingest_id FROM enc"),
)
def reorder(spark, sf):
    return frames.reorder(
        _rows(spark, sf, "e_date", "iv_date", "regimen_a"), ["iv_date", "hosp_id", "e_date", "regimen_a", "iv_date"]
    )


@query(
    "cohort",
    with_enc("""SELECT ingest_id, hosp_id, dx_date FROM enc
WHERE dx_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""),
)
def cohort(spark, sf):
    return frames.cohort(_rows(spark, sf, "dx_date"), "dx_date", date(2024, 1, 5), date(2024, 1, 20))


@query(
    "keep_label",
    with_enc("SELECT ingest_id, hosp_id, encounter_type FROM enc WHERE encounter_type = 'Initial'"),
)
def keep_label(spark, sf):
    return frames.keep_label(_rows(spark, sf, "encounter_type"), "encounter_type", "Initial")


@query(
    "apply_corrections",
    with_enc("""SELECT ingest_id, hosp_id, CASE WHEN hosp_id = 7 THEN DATE '2015-05-27'
 WHEN hosp_id IS NULL THEN NULL ELSE dx_date END AS dx_date FROM enc"""),
)
def apply_corrections(spark, sf):
    return frames.apply_corrections(_rows(spark, sf, "dx_date"), "hosp_id", "dx_date", {7: date(2015, 5, 27)})


@query(
    "sort_longitudinal",
    with_enc("SELECT ingest_id, hosp_id, e_date FROM enc ORDER BY hosp_id NULLS LAST, e_date NULLS LAST, ingest_id"),
)
def sort_longitudinal(spark, sf):
    return frames.sort_longitudinal(_rows(spark, sf, "e_date"), ["hosp_id", "e_date"])


@query(
    "parse_dates",
    with_enc(r"""SELECT ingest_id,
 CAST(try_strptime(regexp_extract(date_text, '^\s*(\d{1,2}/\d{1,2}/\d{4})', 1), '%m/%d/%Y') AS DATE) AS date_text
FROM enc"""),
)
def parse_dates(spark, sf):
    return frames.parse_dates(enc(spark, sf).select("ingest_id", "date_text"), ["date_text"])


@query(
    "date_from_year",
    with_enc("SELECT ingest_id, birth_year, make_date(birth_year, 1, 1) AS birth_date FROM enc"),
)
def date_from_year(spark, sf):
    return frames.date_from_year(enc(spark, sf).select("ingest_id", "birth_year"), "birth_year", "birth_date").select(
        "ingest_id", "birth_year", F.col("birth_date")
    )


@query(
    "apply_corrections_intent",
    with_enc("SELECT ingest_id, hosp_id, CASE WHEN hosp_id = 7 THEN DATE '2015-05-27' ELSE dx_date END AS dx_date FROM enc"),
)
def apply_corrections_intent(spark, sf):
    return frames.apply_corrections(_rows(spark, sf, "dx_date"), "hosp_id", "dx_date", {7: date(2015, 5, 27)}, intent=True)


# Every third order corrects the ship dates of its lines; some lines have lost their order's key.
_LINES = "SELECT l_orderkey * 10 + l_linenumber AS ingest_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS hosp_id, l_shipdate AS dx_date FROM lineitem"
_FIXES = "SELECT o_orderkey AS k, o_orderdate AS v FROM orders WHERE o_orderkey % 3 = 0"


def _line_corrections(spark, sf, intent):
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("lineitem")
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    return frames.apply_corrections(spark.sql(_LINES), "hosp_id", "dx_date", spark.sql(_FIXES), intent)


@query(
    "corrections_table",
    f"""SELECT ingest_id, hosp_id, CASE WHEN hosp_id IS NULL THEN NULL WHEN k IS NOT NULL THEN v ELSE dx_date END AS dx_date
FROM ({_LINES}) LEFT JOIN ({_FIXES}) ON k = hosp_id""",
)
def corrections_table(spark, sf):
    return _line_corrections(spark, sf, intent=False)


@query(
    "corrections_table_intent",
    f"""SELECT ingest_id, hosp_id, CASE WHEN k IS NOT NULL THEN v ELSE dx_date END AS dx_date
FROM ({_LINES}) LEFT JOIN ({_FIXES}) ON k = hosp_id""",
)
def corrections_table_intent(spark, sf):
    return _line_corrections(spark, sf, intent=True)


CHAIN = [
    chain.FillMin("iv_date", "e_date"),
    chain.FillMin("dx_date"),
    chain.GroupMax("e_date", "latest_encounter"),
    chain.GroupCount("n_encounters"),
    chain.HarmoniseMin("dx_date"),
    chain.Ordinal("record_count"),
    chain.LeadFill("creatinine_raw", "encounter_type", "Initial", 7, "creatinine"),
]


@query(
    "repair_chain",
    with_enc(f"""SELECT ingest_id, hosp_id, e_date, encounter_type, creatinine_raw, coalesce(iv_date, min(e_date) {_BY}) AS iv_date,
 min(dx_date) {_BY} AS dx_date, max(e_date) {_BY} AS latest_encounter, count(*) {_BY} AS n_encounters, row_number() OVER ({_ORDER}) AS record_count,
 CASE WHEN encounter_type = 'Initial' AND creatinine_raw IS NULL AND date_diff('day', lag(e_date) OVER ({_ORDER}), e_date) < 7
  THEN lead(creatinine_raw) OVER ({_ORDER}) ELSE creatinine_raw END AS creatinine FROM enc"""),
)
def repair_chain(spark, sf):
    rows = _rows(spark, sf, "e_date", "iv_date", "dx_date", "encounter_type", "creatinine_raw")
    return chain.repair_chain(rows, "hosp_id", "e_date", CHAIN)
