"""Recoding, keyword flags and ordered rules."""

from __future__ import annotations

from ..functions import text as t
from ..plans import dictionaries as d
from ..plans.bindings import enc, registry_rows, table
from .base import (
    query, sql_cascade, sql_flag, sql_label, sql_recode, sql_sequential, with_enc, with_registry,
)


@query(
    "recode_exact",
    with_enc(f"""SELECT ingest_id, {sql_recode("outcome", d.OUTCOMES)} AS outcome,
 {sql_recode("bleeding_site", d.BLEEDING_SITES)} AS bleeding_site,
 {sql_recode("swelling_site", d.SWELLING_SITES)} AS swelling_site FROM enc"""),
)
def recode_exact(spark, sf):
    return enc(spark, sf).selectExpr(
        "ingest_id",
        t.recode_exact("outcome", d.OUTCOMES) + " AS outcome",
        t.recode_exact("bleeding_site", d.BLEEDING_SITES) + " AS bleeding_site",
        t.recode_exact("swelling_site", d.SWELLING_SITES) + " AS swelling_site",
    )


_REGIMENS = ["regimen_a", "regimen_b", "regimen_c"]


@query(
    "recode_regimens",
    with_enc(
        "SELECT ingest_id, " + ", ".join(f"{sql_recode(c, d.REGIMENS)} AS {c}" for c in _REGIMENS) + " FROM enc"
    ),
)
def recode_regimens(spark, sf):
    return enc(spark, sf).selectExpr(
        "ingest_id", *[f"{t.recode_exact(c, d.REGIMENS)} AS {c}" for c in _REGIMENS]
    )


_PLAN = sql_recode(f"({sql_recode('remission_plan', d.REMISSION_CODES)})", d.REMISSION_PLANS)


def _plan():
    return t.recode_exact(t.recode_exact("remission_plan", d.REMISSION_CODES), d.REMISSION_PLANS)


@query("recode_remission", with_enc(f"SELECT ingest_id, {_PLAN} AS remission_plan FROM enc"))
def recode_remission(spark, sf):
    return enc(spark, sf).selectExpr("ingest_id", f"{_plan()} AS remission_plan")


_CODED = {"complaint_codes": d.COMPLAINT_CODES, "pain_codes": d.PAIN_CODES, "sign_codes": d.SIGN_CODES}


@query(
    "recode_sequential",
    with_enc(
        "SELECT ingest_id, " + ", ".join(f"{sql_sequential(c, v)} AS {c}" for c, v in _CODED.items()) + " FROM enc"
    ),
)
def recode_sequential(spark, sf):
    return enc(spark, sf).selectExpr(
        "ingest_id", *[f"{t.recode_sequential(c, v)} AS {c}" for c, v in _CODED.items()]
    )


@query(
    "recode_tokens",
    with_enc(f"""SELECT ingest_id, array_to_string(list_transform(string_split(complaint_codes, ';'),
 lambda x: {sql_recode("x", dict(d.COMPLAINT_CODES))}), ';') AS complaint_codes FROM enc"""),
)
def recode_tokens(spark, sf):
    return enc(spark, sf).selectExpr(
        "ingest_id", t.recode_tokens("complaint_codes", dict(d.COMPLAINT_CODES)) + " AS complaint_codes"
    )


_FLAGGED = [
    ("complaint_codes", d.COMPLAINT_CODES, d.COMPLAINT_FLAGS),
    ("pain_codes", d.PAIN_CODES, d.PAIN_FLAGS),
    ("sign_codes", d.SIGN_CODES, d.SIGN_FLAGS),
]


def _flags_sql(columns, source):
    inner = ", ".join(f"{sql_sequential(c, codes)} AS {c}" for c, codes, _ in columns)
    outer = ", ".join(f"{sql_flag(c, p)} AS {name}" for c, _, flags in columns for name, p in flags.items())
    return f"SELECT ingest_id, {outer} FROM (SELECT ingest_id, {inner} FROM {source})"


@query("keyword_flags", with_enc(_flags_sql(_FLAGGED, "enc")))
def keyword_flags(spark, sf):
    return _flagged(enc(spark, sf), _FLAGGED)


def _flagged(rows, columns):
    decoded = rows.selectExpr("ingest_id", *[f"{t.recode_sequential(c, codes)} AS {c}" for c, codes, _ in columns])
    return decoded.selectExpr(
        "ingest_id",
        *[f"{t.keyword_flag(c, p)} AS {name}" for c, _, flags in columns for name, p in flags.items()],
    )


_PAINS_INTENT = [("pain_codes", d.PAIN_CODES, d.PAIN_FLAGS_INTENT)]


@query("pain_flags_intent", with_enc(_flags_sql(_PAINS_INTENT, "enc")))
def pain_flags_intent(spark, sf):
    """The fifth flag looks for no pain site, where the specified one repeats the upper limb."""
    return _flagged(enc(spark, sf), _PAINS_INTENT)


@query(
    "keyword_flags_documents",
    "SELECT doc_id, " + ", ".join(f"{sql_flag('text', p)} AS {n}" for n, p in d.COMPLAINT_FLAGS.items()) + " FROM documents",
)
def keyword_flags_documents(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "doc_id", *[f"{t.keyword_flag('text', p)} AS {n}" for n, p in d.COMPLAINT_FLAGS.items()]
    )


@query(
    "ordered_category",
    with_enc(f"""SELECT ingest_id, {sql_label("ecog_index", d.ECOG)} AS ecog_label,
 CAST(CASE WHEN ecog_index BETWEEN 0 AND 4 THEN ecog_index + 1 END AS INT) AS ecog_rank FROM enc"""),
)
def ordered_category(spark, sf):
    return enc(spark, sf).selectExpr(
        "ingest_id",
        t.ordered_label("ecog_index", d.ECOG) + " AS ecog_label",
        t.ordered_rank("ecog_index", d.ECOG) + " AS ecog_rank",
    )


@query(
    "first_present",
    with_enc("SELECT ingest_id, coalesce(regimen_a, regimen_b, regimen_c) AS treatment FROM enc"),
)
def first_present(spark, sf):
    return enc(spark, sf).selectExpr("ingest_id", t.first_present(*_REGIMENS) + " AS treatment")


@query(
    "first_present_cycle",
    with_registry("SELECT ingest_id, coalesce(cycle_start, cycle_cont, cycle_chemo) AS cycle FROM reg"),
)
def first_present_cycle(spark, sf):
    cycle = t.first_present("cycle_start", "cycle_cont", "cycle_chemo")
    return registry_rows(spark, sf).selectExpr("ingest_id", f"{cycle} AS cycle")


# Rules on the notes of events, some with a wildcard, the last one never reached.
_EVENT_RULES = [
    ("purchase", "bought"),
    ('"k": 1.', "tens"),
    ("click|view", "seen"),
    ("error .", "failed"),
    ('"k": 12', "twelve"),
]


@query(
    "rule_cascade_events",
    with_enc(f"SELECT ingest_id, {sql_cascade('regimen_a', 'notes', _EVENT_RULES)} AS treatment FROM enc"),
)
def rule_cascade_events(spark, sf):
    value = t.rule_cascade("regimen_a", "notes", _EVENT_RULES)
    return enc(spark, sf).selectExpr("ingest_id", f"{value} AS treatment")


_FIRST = "coalesce(regimen_start, regimen_cont, regimen_chemo)"


@query(
    "rule_cascade",
    with_registry(f"SELECT ingest_id, {sql_cascade(_FIRST, 'notes', d.NOTE_RULES)} AS treatment FROM reg"),
)
def rule_cascade(spark, sf):
    given = t.first_present("regimen_start", "regimen_cont", "regimen_chemo")
    return registry_rows(spark, sf).selectExpr(
        "ingest_id", t.rule_cascade(given, "notes", d.NOTE_RULES) + " AS treatment"
    )


@query(
    "rule_cascade_documents",
    f"SELECT doc_id, {sql_cascade('NULL', 'text', d.NOTE_RULES)} AS treatment FROM documents",
)
def rule_cascade_documents(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "doc_id", t.rule_cascade("string(NULL)", "text", d.NOTE_RULES) + " AS treatment"
    )


def _maintenance(notes):
    return [(notes, d.MAINTENANCE)]


@query(
    "plan_fill",
    with_registry(f"""SELECT ingest_id,
 {sql_cascade(_PLAN, "notes", _maintenance(d.MAINTENANCE_NOTES), "(?is)")} AS remission_plan,
 {sql_cascade(_PLAN, "notes", _maintenance(d.MAINTENANCE_NOTES_INTENT), "(?is)")} AS remission_plan_intent FROM reg"""),
)
def plan_fill(spark, sf):
    def filled(notes):
        return t.rule_cascade(_plan(), "notes", _maintenance(notes), ignore_case=True)

    return registry_rows(spark, sf).selectExpr(
        "ingest_id",
        filled(d.MAINTENANCE_NOTES) + " AS remission_plan",
        filled(d.MAINTENANCE_NOTES_INTENT) + " AS remission_plan_intent",
    )
