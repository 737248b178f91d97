"""Kaplan-Meier and Cox against values computed without Spark."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import cox, survival as sv
from cohortline.operators.cox import Covariate, coxph

SURV12 = [
    ("p01", 1.0, 1, "a", 210.0),
    ("p02", 2.5, 1, "b", 90.0),
    ("p03", 2.5, 1, "a", 180.0),
    ("p04", 2.5, 0, "a", 100.0),
    ("p05", 4.1, 0, "b", 150.0),
    ("p06", 6.0, 1, "b", 240.0),
    ("p07", 6.0, 0, "a", 80.0),
    ("p08", 7.7, 1, "a", 120.0),
    ("p09", 9.3, 0, "b", 70.0),
    ("p10", 9.3, 1, "b", 95.0),
    ("p11", None, 1, "a", 50.0),
    ("p12", 12.0, 0, "b", None),
]
SPLIT = [10**6, 2]  # one sorted task, or ranges of two times
GRP = Covariate("grp", "category")
CREAT = Covariate("c100")


@pytest.fixture(scope="module")
def surv12(spark):
    df = spark.createDataFrame(SURV12, "id string, months double, status int, grp string, creat double")
    return df.withColumn("c100", F.col("creat") / 100).cache()


@pytest.mark.parametrize("sorted_rows", SPLIT)
def test_kaplan_meier(surv12, sorted_rows):
    km = sv.kaplan_meier(surv12, "months", "status", sorted_rows=sorted_rows)
    got = [
        tuple(r)
        for r in km.orderBy("time")
        .select(
            "time", "n_risk", "n_event", "n_censor", *[F.round(c, 6) for c in ("surv", "std_err", "lower", "upper")]
        )
        .collect()
    ]
    assert got == [
        (1.0, 11, 1, 0, 0.909091, 0.086678, 0.754134, 1.0),
        (2.5, 10, 2, 1, 0.727273, 0.134282, 0.506447, 1.0),
        (4.1, 7, 0, 1, 0.727273, 0.134282, 0.506447, 1.0),
        (6.0, 6, 1, 1, 0.606061, 0.157371, 0.364327, 1.0),
        (7.7, 4, 1, 0, 0.454545, 0.176489, 0.212362, 0.972921),
        (9.3, 3, 1, 1, 0.303030, 0.170729, 0.100442, 0.914232),
        (12.0, 1, 0, 1, 0.303030, 0.170729, 0.100442, 0.914232),
    ]
    s = sv.km_summary(km, sorted_rows=sorted_rows).first()
    assert (s.records, s.events, s.median, s.median_lower, s.median_upper) == (11, 6, 7.7, 6.0, None)
    assert round(s.rmean, 6) == 7.484848
    at = sv.km_at(km, [6.5, 13.0]).collect()
    assert [(r.time, r.n_risk, r.n_event, round(r.surv, 6)) for r in at] == [(6.5, 4, 4, 0.606061)]


def test_curve_that_reaches_zero(spark):
    df = spark.createDataFrame([(float(t), 1) for t in (1, 2, 3, 4)], "t double, s int")
    km = sv.kaplan_meier(df, "t", "s")
    rows = km.orderBy("time").collect()
    assert [round(r.surv, 12) for r in rows] == [0.75, 0.5, 0.25, 0.0]
    assert rows[-1].lower is None and rows[-1].std_err is None
    assert sv.km_summary(km).first().median == 2.5


def test_strata_risk_table_and_curve(surv12):
    km = sv.kaplan_meier(surv12, "months", "status", ["grp"])
    alone = sv.kaplan_meier(surv12.filter("grp = 'a'"), "months", "status")
    got = [(r.time, r.n_risk, r.surv) for r in km.filter("grp = 'a'").orderBy("time").collect()]
    assert got == [(r.time, r.n_risk, r.surv) for r in alone.orderBy("time").collect()]
    table = sv.risk_table(surv12, "months", sv.regular_breaks(surv12, "months", 3), "status").collect()
    assert [(r.time, r.n_risk) for r in table] == [(0.0, 11), (3.0, 7), (6.0, 6), (9.0, 3), (12.0, 1)]
    assert table[0].pct_risk == 100.0
    curve = sv.km_curve(sv.kaplan_meier(surv12, "months", "status"))
    assert curve.filter("kind = 'step' AND time = 0 AND surv = 1").count() == 1
    guides = sorted((r.time, r.surv) for r in curve.filter("kind = 'guide'").collect())
    assert guides == [(0.0, 0.5), (7.7, 0.0), (7.7, 0.5)]


def test_estimate_is_monotone_and_equals_survivor_share_without_censoring(spark):
    rng = np.random.default_rng(3)
    times = np.round(rng.exponential(10, 400), 1)
    df = spark.createDataFrame([(float(t), 1) for t in times], "t double, s int").repartition(5)
    rows = sv.kaplan_meier(df, "t", "s", sorted_rows=40).orderBy("time").collect()
    surv = [r.surv for r in rows]
    assert all(a >= b for a, b in zip(surv, surv[1:]))
    for r in rows:
        assert math.isclose(r.surv, float((times > r.time).mean()), abs_tol=1e-9)


GOLDEN = [
    ([GRP], "efron", [-0.980074], [0.923735], -11.174371, -10.596436, 1.155871, 1.125699, 1.212421),
    ([GRP], "breslow", [-0.970853], [0.924050], -11.279732, -10.712912, 1.133640, 1.103865, 1.187112),
    ([CREAT], "efron", [1.563776], [0.803870], -9.980449, -7.937159, 4.086578, 3.784230, 4.941403),
    (
        [CREAT, GRP], "efron", [2.078854, -1.421036], [1.037578, 1.155105],
        -9.980449, -7.056852, 5.847193, 4.056696, 5.756538,
    ),
]


@pytest.mark.parametrize("wide", [cox.WIDE, 0])
@pytest.mark.parametrize("golden", GOLDEN)
def test_cox_goldens(surv12, golden, wide, monkeypatch):
    monkeypatch.setattr(cox, "WIDE", wide)
    covariates, ties, coef, se, ll0, ll, lrt, wald, score = golden
    fit = coxph(surv12, "months", "status", covariates, ties)
    summary = cox.cox_summary(fit).collect()
    assert [round(r.coef, 6) for r in summary] == pytest.approx(coef, abs=2e-6)
    assert [round(r.se, 6) for r in summary] == pytest.approx(se, abs=2e-6)
    t = cox.cox_tests(fit).first()
    assert (t.loglik0, t.loglik, t.lrt, t.wald, t.score) == pytest.approx((ll0, ll, lrt, wald, score), abs=2e-6)
    assert fit.converged and t.loglik >= t.loglik0
    assert t.lrt_p == pytest.approx(cox.chi2_tail(lrt, len(coef)), abs=1e-5)


@pytest.mark.parametrize("sorted_rows", SPLIT)
def test_zph_goldens(surv12, sorted_rows):
    fit = coxph(surv12, "months", "status", [GRP], sorted_rows=sorted_rows)
    assert [(r.term, round(r.chisq, 6), r.df) for r in cox.cox_zph(fit).collect()] == [
        ("grp", 0.033435, 1),
        ("GLOBAL", 0.033435, 1),
    ]
    fit = coxph(surv12, "months", "status", [CREAT, GRP], sorted_rows=sorted_rows)
    out = cox.cox_zph(fit).collect()
    assert [r.chisq for r in out] == pytest.approx([1.099469, 0.023665, 1.101444], abs=3e-6)
    residuals = cox.schoenfeld_residuals(fit)
    sums = {r.term: r.s for r in residuals.groupBy("term").agg(F.sum("residual").alias("s")).collect()}
    assert all(abs(v) < 1e-7 for v in sums.values())  # the score vector at the fit


def brute_cox(times, status, x):
    """Efron fit in numpy."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        u, info, ll = np.zeros(len(beta)), np.zeros((len(beta),) * 2), 0.0
        r = np.exp(x @ beta)
        for t in np.unique(times[status == 1]):
            risk, dead = times >= t, (times == t) & (status == 1)
            m = dead.sum()
            for l in range(m):
                w = r * risk - l / m * r * dead
                s0 = w.sum()
                mean = w @ x / s0
                u += x[dead].sum(0) / m - mean
                info += (x * w[:, None]).T @ x / s0 - np.outer(mean, mean)
                ll += (x[dead] @ beta).sum() / m - np.log(s0)
        step = np.linalg.solve(info, u)
        beta = beta + step
        if np.abs(step).max() < 1e-11:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), ll


@pytest.fixture(scope="module")
def many_terms(spark):
    rng = np.random.default_rng(11)
    n = 500
    level = rng.integers(0, 9, n)
    dose = rng.normal(100, 15, n)
    scale = np.exp(-0.02 * (dose - 100) + 0.1 * level)
    times = np.round(rng.exponential(scale * 12), 0)
    status = (rng.random(n) < 0.7).astype(int)
    rows = [(float(t), int(s), f"L{k}", float(v)) for t, s, k, v in zip(times, status, level, dose)]
    df = spark.createDataFrame(rows, "t double, s int, level string, dose double").cache()
    x = np.column_stack([dose] + [(level == k).astype(float) for k in range(1, 9)])
    return df, times, status, x


@pytest.mark.parametrize("wide", [0, 20])
@pytest.mark.parametrize("sorted_rows", [10**6, 7])
def test_many_terms_against_numpy(many_terms, wide, sorted_rows, monkeypatch):
    monkeypatch.setattr(cox, "WIDE", wide)
    monkeypatch.setattr(cox, "DIRECT_TERMS", 16)  # so that common tie counts pass the closed form
    df, times, status, x = many_terms
    covariates = [Covariate("dose"), Covariate("level", "category")]
    fit = coxph(df, "t", "s", covariates, sorted_rows=sorted_rows)
    beta, se, ll = brute_cox(times, status, x)
    assert fit.coef == pytest.approx(beta, abs=1e-6)
    assert np.sqrt(np.diag(fit.var)) == pytest.approx(se, abs=1e-6)
    assert fit.loglik == pytest.approx(ll, abs=1e-6)
    _, score, _ = cox._evaluate(fit.design, fit.beta, "efron")
    assert np.abs(score).max() < 1e-5


@pytest.mark.parametrize("sorted_rows", [10**6, 50])
def test_concordance_counts_all_pairs(many_terms, sorted_rows):
    df, times, status, x = many_terms
    fit = coxph(df, "t", "s", [Covariate("dose")])
    eta = np.round((x[:, 0] - x[:, 0].mean()) * fit.coef[0], 12)
    good = bad = tied = 0
    for i in np.flatnonzero(status):
        other = (times > times[i]) | ((times == times[i]) & (status == 0))
        good += (eta[i] > eta[other]).sum()
        bad += (eta[i] < eta[other]).sum()
        tied += (eta[i] == eta[other]).sum()
    want = (good + tied / 2) / (good + bad + tied)
    assert cox.concordance(fit, sorted_rows) == pytest.approx(want, abs=1e-12)


def test_collinear_and_empty_levels(spark):
    rows = [(1.0, 1, 1.0, "a"), (2.0, 1, 0.0, "b"), (3.0, 0, 1.0, "c"), (4.0, 1, 3.0, "a"), (5.0, 0, 2.0, "c"), (6.0, 1, 0.5, "b")]
    df = spark.createDataFrame(rows, "t double, s int, x double, g string").withColumn("twice", F.col("x") * 2)
    fit = coxph(df, "t", "s", [Covariate("x"), Covariate("twice")])
    assert fit.kept == [0] and math.isnan(fit.coef[1])
    assert cox.cox_summary(fit).collect()[1].coef is None
    fit = coxph(df, "t", "s", [Covariate("g", "category")])  # no event in level c
    assert not fit.converged


def test_weights_and_encoding(spark, surv12):
    frame = cox.model_frame(surv12, "months", "status", ["grp", "c100"])
    a = coxph(surv12, "months", "status", [GRP])
    b = coxph(frame, "months", "status", [GRP], weight="w")
    assert a.coef == pytest.approx(b.coef, abs=1e-9)
    df = spark.createDataFrame([("x",), ("b",), (None,), ("a",)], "g string")
    assert list(cox.encode(df, "g")) == ["g=b", "g=x"]
    assert list(cox.encode(df, "g", "x")) == ["g=a", "g=b"]
    assert list(cox.encode(df, "g", levels=("x", "a", "unused", "b"))) == ["g=a", "g=b"]


def test_chi2_tail():
    for x, df in ((3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (18.307038053275146, 10)):
        assert cox.chi2_tail(x, df) == pytest.approx(0.05, abs=1e-12)


def test_tied_sums_in_closed_form(spark):
    cases = [(10.0, 3.0, 5), (7.0, 3.0, 256), (10.0, 3.0, 257), (7.0, 3.0, 1000), (3.0, 3.0, 5000), (1e3, 1.0, 70000)]
    df = spark.createDataFrame(cases, "s0 double, e0 double, m long")
    for r in cox._tied_sums(df, "efron").collect():
        share = np.arange(r.m) / r.m
        left = r.s0 - r.e0 * share
        assert r.p0 == pytest.approx((1 / left).sum(), rel=1e-11)
        assert r.q0 == pytest.approx((1 / left**2).sum(), rel=1e-11)
        assert r.p1 == pytest.approx((share / left).sum(), rel=1e-8)
        assert r.q1 == pytest.approx((share / left**2).sum(), rel=1e-8)
        assert r.lg == pytest.approx(np.log(left).sum(), rel=1e-11)


def test_encode_has_no_bound_on_levels(spark):
    df = spark.range(3_000).selectExpr("cast(id % 1500 as string) AS v")
    assert len(cox.encode(df, "v")) == 1_499


def test_regular_risk_table(spark):
    rows = [("a", 0.3, 1), ("a", 0.7, 0), ("a", -1.0, 1), ("b", 0.05, 1), ("b", None, 1), ("b", 0.2, None), (None, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, t double, s int")
    out = {(r.g, round(r.time * 10)): (r.n_risk, round(r.pct_risk, 6)) for r in sv.regular_risk_table(df, "t", 0.1, ["g"], "s").collect()}
    want = {}
    for g, times in (("a", [0.3, 0.7, -1.0]), ("b", [0.05])):
        last = max(i for i in range(9) if i * 0.1 <= 0.7)
        for i in range(last + 1):
            n = sum(t >= i * 0.1 for t in times)
            want[g, i] = (n, round(100 * n / len(times), 6))
    assert out == want
    assert sv.regular_risk_table(df.limit(0), "t", 0.1, ["g"]).count() == 0


def test_models_fitted_at_once_equal_single_fits(many_terms):
    """Models of different widths and missing values settle after different numbers of steps."""
    df, *_ = many_terms
    df = df.withColumn("half", F.when(F.col("dose") > 100, "hi").when(F.col("dose") > 90, "lo")).withColumn("one", F.lit(1.0))
    models = {
        "dose": [Covariate("dose")],
        "level": [Covariate("level", "category")],
        "both": [Covariate("half", "category", "lo"), Covariate("dose")],
        "none": [Covariate("one")],
        "nothing": [],
    }
    fits = cox.coxph_all(df, "t", "s", models)
    assert list(fits) == list(models) and len({f.steps for f in fits.values()}) > 1
    for name, covariates in models.items():
        single = coxph(df, "t", "s", covariates)
        fit = fits[name]
        assert (fit.design.n, fit.design.n_event, fit.design.columns, fit.kept) == (
            single.design.n, single.design.n_event, single.design.columns, single.kept,
        )
        assert fit.coef == pytest.approx(single.coef, abs=1e-9, nan_ok=True)
        assert (fit.loglik0, fit.loglik, fit.score_test) == pytest.approx((single.loglik0, single.loglik, single.score_test), abs=1e-8)
        assert fit.converged and single.converged and fit.steps == single.steps
    table = cox.cox_table({n: fits[n] for n in ("dose", "both")}).collect()
    assert [(r.model, r.term) for r in table] == [("dose", "dose"), ("both", "half=hi"), ("both", "dose")]
    tests = cox.cox_tests_all(fits).collect()
    assert [r.df for r in tests] == [1, 8, 2, 0, 0]
    residuals = cox.schoenfeld_residuals(fits["both"]).groupBy("term").agg(F.sum(F.col("residual") * F.col("n")).alias("s"))
    assert all(abs(r.s) < 1e-6 for r in residuals.collect())


def test_a_step_takes_few_jobs(many_terms):
    """All models share an evaluation: the jobs of seven models are not seven times those of one."""
    df, *_ = many_terms
    tracker = df.sparkSession.sparkContext.statusTracker()

    def jobs(work):
        before = len(tracker.getJobIdsForGroup(None))
        work()
        return len(tracker.getJobIdsForGroup(None)) - before

    one = {"dose": [Covariate("dose")]}
    many = one | {f"m{i}": [Covariate("dose"), Covariate("level", "category")] for i in range(6)}
    assert jobs(lambda: cox.coxph_all(df, "t", "s", many)) < 2 * jobs(lambda: cox.coxph_all(df, "t", "s", one))


def test_models_of_no_rows(spark):
    df = spark.createDataFrame([], "t double, s int, x double, g string")
    fits = cox.coxph_all(df, "t", "s", {"x": [Covariate("x")], "g": [Covariate("g", "category")]})
    assert [(f.design.n, f.kept, f.converged) for f in fits.values()] == [(0, [], True), (0, [], True)]


def test_pair_counts_in_ranges(spark):
    """Ranges of scores and times give the pairs that all pairs give, with ties in both."""
    rng = np.random.default_rng(3)
    times, scores, status = rng.integers(0, 12, 300), rng.integers(0, 9, 300) / 4, rng.integers(0, 2, 300)
    good = bad = tied = 0
    for i in np.flatnonzero(status):
        other = (times > times[i]) | ((times == times[i]) & (status == 0))
        good += (scores[i] > scores[other]).sum()
        bad += (scores[i] < scores[other]).sum()
        tied += (scores[i] == scores[other]).sum()
    assert cox._pair_counts(times, scores, status, 1 - status).tolist() == [good, bad, tied]
    df = spark.createDataFrame([(float(t), float(x), int(s)) for t, x, s in zip(times, scores, status)], "t double, x double, s int")
    fit = coxph(df, "t", "s", [Covariate("x")])
    fit.coef[0] = 1.0
    for rows in (10**6, 40, 7, 1):
        assert cox.concordance(fit, rows) == pytest.approx((good + tied / 2) / (good + bad + tied), abs=1e-12)
