"""Scalar and text rules, one missing-value or ordering rule per case."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortline.functions import clinical as c, dates, nulls, text as t
from cohortline.plans import dictionaries as d


def apply(spark, schema, rows, *exprs):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    columns = [F.expr(e) if isinstance(e, str) else e for e in exprs]
    out = df.select("i", *[c.alias(f"o{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in out]


def test_ifelse3_keeps_unknown(spark):
    out = apply(spark, "x int", [(1,), (0,), (None,)], nulls.ifelse3(F.col("x") > 0, F.lit("a"), F.lit("b")))
    assert out == ["a", "b", None]


def test_missing_text_matches_nothing(spark):
    out = apply(
        spark,
        "s string",
        [("x BONE pain",), (None,), ("bone\npain",)],
        t.text_match("s", "bone pain", ignore_case=True),
        t.text_match("s", "bone.pain"),
    )
    assert out == [(True, False), (False, False), (False, True)]


@pytest.mark.parametrize("pattern", ["other|others", "(bone|back) pain", "k: 1."])
def test_literal_search_equals_regex(spark, pattern):
    rows = [("The OTHERS",), ("back pain",), ("k: 1",), ("k: 12",), ("BONE PAIN",), (None,)]
    got = apply(spark, "s string", rows, t.text_match("s", pattern, ignore_case=True))
    want = apply(spark, "s string", rows, F.coalesce(F.col("s").rlike("(?is)" + pattern), F.lit(False)))
    assert got == want


def test_bands(spark):
    out = apply(
        spark,
        "x double, h double",
        [(177.0, 9.9), (177.1, 10.0), (None, None)],
        c.band(F.col("x"), 177, "<=177", "> 177", True),
        c.band(F.col("h"), 10, "< 10", ">=10", False),
    )
    assert out == [("<=177", "< 10"), ("> 177", ">=10"), (None, None)]


def test_corrected_calcium(spark):
    rows = [(2.5, 30.0), (2.5, 40.0), (2.5, 45.0), (2.5, 50.0), (2.5, None), (None, 42.0)]
    out = apply(spark, "ca double, al double", rows, c.corrected_calcium(F.col("ca"), F.col("al")))
    assert [None if v is None else round(v, 9) for v in out] == [2.7, 2.5, 2.5, 2.4, None, None]


def test_hypercalcemia(spark):
    out = apply(spark, "v double", [(2.75,), (2.76,), (None,)], c.yes_no(F.col("v") > 2.75))
    assert out == ["No", "Yes", None]


def test_status_and_label_differ_on_missing(spark):
    rows = [("Alive",), ("LTFU",), ("Deceased",), ("alive",), (None,)]
    out = apply(
        spark,
        "s string",
        rows,
        c.event_flag(F.col("s"), d.CENSORED),
        c.censor_label(F.col("s"), d.CENSORED),
        c.censor_label(F.col("s"), d.CENSORED, intent=True),
    )
    assert out == [
        (0, "censored", "censored"),
        (0, "censored", "censored"),
        (1, "Deceased", "Deceased"),
        (1, "Deceased", "Deceased"),
        (None, "Deceased", None),
    ]


def test_remission_flags(spark):
    day = date(2020, 1, 1)
    rows = [
        (True, None, None),
        (False, day, None),
        (False, None, "Drug Holiday"),
        (False, None, "stop all medications"),
        (False, None, None),
        (None, day, "Drug Holiday"),
    ]
    by_date = c.remission_by_date(F.col("f"), F.col("day"))
    plan = F.col("p")
    out = apply(
        spark,
        "f boolean, day date, p string",
        rows,
        by_date,
        c.remission_by_plan(by_date, plan, d.STOP_PLAN),
        c.remission_by_plan(by_date, plan, d.STOP_PLAN, intent=True),
    )
    assert out == [
        (True, True, True),
        (True, True, True),
        (False, True, True),
        (False, True, False),
        (False, None, False),
        (None, None, None),
    ]


def test_dates(spark):
    rows = [("3/5/2020",), ("03/05/2020",), ("2/30/2020",), ("13/5/2020",), ("zz",), ("3/5/2020 10:00",), (None,)]
    out = apply(spark, "s string", rows, dates.parse_date(F.col("s")))
    march = date(2020, 3, 5)
    assert out == [march, march, None, None, None, march, None]


def test_age_and_survival_time(spark):
    rows = [(1960, date(2020, 12, 31)), (1960, date(2021, 1, 1)), (None, date(2020, 1, 1))]
    birth = dates.date_from_year(F.col("y"))
    assert apply(spark, "y int, d date", rows, dates.whole_years(birth, F.col("d"))) == [60, 61, None]
    rows = [(date(2020, 1, 1), date(2020, 3, 2)), (date(2020, 1, 4), date(2020, 1, 1))]
    units = [dates.survival_time(F.col("a"), F.col("b"), u) for u in ("days", "months", "years")]
    out = apply(spark, "a date, b date", rows, *units)
    assert out == [(61.0, 2.0, 0.2), (-3.0, -0.1, -0.0)]


def test_recode_exact(spark):
    out = apply(
        spark, "s string", [("DECEASED",), ("deceased",), ("Alive",), (None,)],
        t.recode_exact("s", d.OUTCOMES),
    )
    assert out == ["Deceased", "Deceased", "Alive", None]
    out = apply(
        spark, "s string", [("LL",), ("BILATERAL LL",), ("ll",)], t.recode_exact("s", d.SWELLING_SITES)
    )
    assert out == ["Lower Limb", "Bilateral Swelling", "ll"]
    out = apply(
        spark, "s string", [("1",), ("15",), ("2;7",), ("9",), (None,)], t.recode_exact("s", d.REGIMENS)
    )
    assert out == ["VTD", "Others", "TD", "9", None]


def test_recode_sequential_and_tokens(spark):
    rows = [("1;3",), ("10",), ("13;14",), ("15",), ("114",), ("2 weeks",), ("Fatique",), (None,)]
    out = apply(
        spark,
        "s string",
        rows,
        t.recode_sequential("s", d.COMPLAINT_CODES),
        t.recode_tokens("s", dict(d.COMPLAINT_CODES)),
    )
    assert out == [
        ("Bone Pain;Fatigue", "Bone Pain;Fatigue"),
        ("Paralysis", "Paralysis"),
        ("Others;None", "Others;None"),
        ("Bone PainDecreased urine output", "15"),
        ("Bone PainNone", "114"),
        ("Diziness weeks", "2 weeks"),
        ("Fatique", "Fatique"),
        (None, None),
    ]


def test_flags(spark):
    rows = [("BONE pain",), ("Fatique",), ("mother",), (None,)]
    names = ["bone_pain", "fatigue", "others_complaint"]
    out = apply(spark, "s string", rows, *[t.keyword_flag("s", d.COMPLAINT_FLAGS[n]) for n in names])
    assert out == [("Yes", "No", "No"), ("No", "Yes", "No"), ("No", "No", "Yes"), ("No", "No", "No")]
    rows = [("Upper Limb",), ("None",)]
    for flags, want in ((d.PAIN_FLAGS, [("Yes", "Yes"), ("No", "No")]), (d.PAIN_FLAGS_INTENT, [("Yes", "No"), ("No", "Yes")])):
        got = apply(spark, "s string", rows, *[t.keyword_flag("s", flags[n]) for n in ("upper_limb", "no_pain_site")])
        assert got == want


def test_ordered_category(spark):
    rows = [(0,), (4,), (5,), (None,)]
    out = apply(spark, "x int", rows, t.ordered_label("x", d.ECOG), t.ordered_rank("x", d.ECOG))
    assert out == [("Normal", 1), ("bedridden 100%", 5), (None, None), (None, None)]


def test_rule_cascade(spark):
    rows = [
        (None, "on TD then on VTD"),
        (None, "ON TD"),
        ("VD", "on TD"),
        (None, "CT THALIDOMIDE"),
        (None, "CT THALIDOMIDE\nnow"),
        (None, None),
    ]
    out = apply(spark, "o string, n string", rows, t.rule_cascade("o", "n", d.NOTE_RULES))
    assert out == ["TD", None, "VD", None, "T", None]


def test_remission_plan(spark):
    rows = [("1",), ("2",), ("3",), ("4",), ("stop all medications",)]
    plan = t.recode_exact(t.recode_exact("p", d.REMISSION_CODES), d.REMISSION_PLANS)
    m = "On Maintenance Therapy"
    assert apply(spark, "p string", rows, plan) == ["Drug Holiday", "Drug Holiday", m, m, "stop all medications"]
    rows = [(None, "for MAINTENANCE"), (None, "IN REMISSION"), ("x", "maintenance")]
    for notes, want in ((d.MAINTENANCE_NOTES, [m, None, "x"]), (d.MAINTENANCE_NOTES_INTENT, [m, m, "x"])):
        filled = t.rule_cascade("p", "n", [(notes, m)], ignore_case=True)
        assert apply(spark, "p string, n string", rows, filled) == want


def test_rule_guard_leaves_out_no_match(spark):
    guard = t._guard([p for p, _ in d.NOTE_RULES], False)
    assert len(guard) < 20
    for pattern, _ in d.NOTE_RULES:
        assert any(g in pattern.rstrip(".") for g in guard)
    assert t._guard(["a(b|c)"], False) is None
    assert t._words("others|other", True) == ["other"]
    rows = [(None, f"x {p.rstrip('.')} y") for p, _ in d.NOTE_RULES] + [(None, "nothing of that")]
    plain = "coalesce(o, CASE " + " ".join(f"WHEN n RLIKE {t.quoted('(?s)' + p)} THEN {t.quoted(v)}" for p, v in d.NOTE_RULES) + " END)"
    got = apply(spark, "o string, n string", rows, t.rule_cascade("o", "n", d.NOTE_RULES), plain)
    assert all(a == b for a, b in got) and got[-1] == (None, None)
