"""The registry's joint model against a fit in numpy of the same rows."""

import numpy as np
import pytest
from test_survival import brute_cox

from cohortline.plans import bindings as b, clinical as cl

SF = "/root/testdata/sf0.01"


def test_joint_model(spark):
    initial = cl.initial_visits(cl.registry(b.registry_rows(spark, SF), b.REGISTRY_CORRECTIONS, b.REGISTRY_COHORT))
    cols = [c.col for c in cl.JOINT_MODEL]
    frame = initial.select("survival_months", "survival_status", *cols).dropna()
    fit = cl.joint_cox(initial)
    rows = frame.collect()
    assert fit.design.n == len(rows)
    x = []
    for name in fit.design.columns:
        col, _, level = name.partition("=")
        x.append([float(r[col] == level) if level else float(r[col]) for r in rows])
    x = np.array(x).T
    kept = fit.kept
    times = np.array([r[0] for r in rows])
    status = np.array([r[1] for r in rows])
    beta, se, ll = brute_cox(times, status, x[:, kept] - x[:, kept].mean(0))
    assert fit.converged
    assert fit.coef[kept] == pytest.approx(beta, abs=1e-5)
    assert np.sqrt(np.diag(fit.var)[kept]) == pytest.approx(se, abs=1e-5)
    assert fit.loglik == pytest.approx(ll, abs=1e-4)
