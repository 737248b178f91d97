"""Cox fits on numbered levels against fits on 0/1 columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import cox, wide_cox as wx
from cohortline.operators.cox import Covariate


def people(spark, n, levels, seed=5):
    rng = np.random.default_rng(seed)
    level = rng.integers(0, levels, n)
    dose = rng.normal(50, 10, n)
    times = np.round(rng.exponential(20 * np.exp(0.02 * (dose - 50) - 0.1 * (level % 7))), 0)
    status = (rng.random(n) < 0.8).astype(int)
    rows = [(float(t), int(s), f"L{k:05d}", float(d), "ab"[int(d) % 2]) for t, s, k, d in zip(times, status, level, dose)]
    rows += [(1.0, 1, None, 50.0, "a"), (None, 1, "L00000", 50.0, "a"), (2.0, 0, "L00001", None, "b")]
    return spark.createDataFrame(rows, "t double, s int, level string, dose double, side string")


@pytest.mark.parametrize("sorted_rows", [10**6, 7])
@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_equal_to_dummies(spark, ties, sorted_rows):
    if ties == "breslow" and sorted_rows == 7:
        pytest.skip("ranges don't depend on the ties")
    df = people(spark, 400, 6).cache()
    covariates = [Covariate("level", "category", "L00002"), Covariate("dose"), Covariate("side", "category", levels=("b", "c"))]
    plain = cox.coxph(df, "t", "s", covariates, ties)
    fit = wx.coxph_wide(df, "t", "s", covariates, ties, sorted_rows=sorted_rows)
    assert fit.converged and (fit.n, fit.n_event) == (plain.design.n, plain.design.n_event)
    assert (fit.loglik0, fit.loglik) == pytest.approx((plain.loglik0, plain.loglik), abs=1e-8)
    found = {r.term: (r.coef, r.exp_coef) for r in wx.wide_coefficients(fit).collect()}
    want = {r.term: (r.coef, r.exp_coef) for r in cox.cox_summary(plain).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    if sorted_rows > 7:
        errors = {r.term: r.se for r in wx.wide_errors(fit, ["dose", "level=L00004"]).collect()}
        assert errors == pytest.approx({r.term: r.se for r in cox.cox_summary(plain).collect() if r.term in errors}, abs=1e-8)


def test_numbers_of_levels(spark):
    df = spark.createDataFrame([("x",), ("b",), (None,), ("a",), ("b",)], "g string")

    def numbers(*more, **options):
        return {r.level: r.number for r in wx.number_levels(df, "g", *more, **options).collect()}

    assert numbers() == {"a": 0, "b": 1, "x": 2} == numbers(sorted_rows=1)
    assert numbers("x") == {"x": 0, "a": 1, "b": 2} and numbers("gone") == {"a": 0, "b": 1, "x": 2}
    assert numbers(None, ("x", "unused", "b")) == {"x": 0, "b": 1, "a": 2}
    coded = wx.encode_levels(df, "g", wx.number_levels(df, "g"), "n").collect()
    assert sorted((r.g or "", r.n) for r in coded if r.g) == [("a", 0), ("b", 1), ("b", 1), ("x", 2)]
    assert [r.n for r in coded if r.g is None] == [None]


def test_five_thousand_levels(spark):
    """Every level has events; at the fit the score vanishes, and the plan is that of a model of two levels."""
    df = spark.range(30_000).select(
        F.format_string("L%04d", F.col("id") % 5_000).alias("level"),
        (F.pmod(F.xxhash64("id"), F.lit(400)) / 4 + F.lit(1)).alias("t"),
        F.when(F.col("id") % 6 < 4, 1).otherwise(0).alias("s"),
    )
    fit = wx.coxph_wide(df, "t", "s", [Covariate("level", "category")])
    assert fit.converged and len(fit.coef) == 4_999 and fit.loglik > fit.loglik0
    score = wx._per_covariate(fit.rows, 4_999, {"u": "v * (d - r * a + rd * p1)"})[0]
    assert np.abs(score).max() < 1e-6
    two = wx.coxph_wide(df.where("level < 'L0003'"), "t", "s", [Covariate("level", "category")])
    plans = [len(wx._weighted(f.rows, f.coef, "y")._jdf.queryExecution().optimizedPlan().toString()) for f in (fit, two)]
    assert max(plans) < 1.3 * min(plans)


def test_no_rows(spark):
    df = spark.createDataFrame([], "t double, s int, g string, x double")
    fit = wx.coxph_wide(df, "t", "s", [Covariate("g", "category"), Covariate("x")])
    assert (fit.n, fit.converged) == (0, True) and [r.coef for r in wx.wide_coefficients(fit).collect()] == [0.0]
