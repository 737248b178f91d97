"""Cox models of any width as SQL for the checking engine: Newton's steps written out, each solved by Gauss-Jordan elimination.

A model is kept in long tables: its rows d (id, t, s), their non-zero covariates x (id, j, v), the products xx (id, i, j, v) with i <= j and place 0
for the constant, and coefficients b (j, b). A step joins event times with the rows at risk, as the definition of the partial likelihood has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.cox import Covariate
from ..operators.survival import Z95
from .base import quoted

STEPS = 7


def tail(x: str, df: str) -> str:
    """P(chi-squared with df degrees of freedom > x) by the series of the incomplete gamma function."""
    half = f"(CAST({df} AS DOUBLE) / 2 + n)"
    terms = f"[exp({half} * ln(({x}) / 2) - ({x}) / 2 - lgamma({half} + 1)) for n in range(0, 3000)]"
    return f"CASE WHEN ({x}) > 0 THEN greatest(0, 1 - list_sum({terms})) ELSE 1.0 END"


def gauss_jordan(matrix: str) -> str:
    """The reduced form of a matrix (a list of rows), by elimination of as many columns as there are rows."""
    cell = "CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] * m[k][j] / m[k][k] END"
    rows = f"list_transform(m, lambda r, i: list_transform(r, lambda v, j: {cell}))"
    return f"list_reduce(range(1, len({matrix}) + 1), lambda m, k: {rows}, {matrix})"


def design_sql(tag: str, source: str, time: str, status: str, covariates: Sequence[Covariate]) -> list[str]:
    """CTEs d, names (j, term, k), x, xx, ev (t, l, u: one row for each tied event) and b_<tag>_0 of a model of the table `source`."""
    cols = [c.col for c in covariates]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [time, status, *cols])
    levels, values = [], []
    for k, cov in enumerate(covariates):
        if cov.kind == "category":
            listed = list(cov.levels or ())
            place = " ".join(f"WHEN {quoted(v)} THEN {i}" for i, v in enumerate(listed))
            order = f"CASE level {place} ELSE {len(listed)} END" if listed else "0"
            first = f"coalesce(level = {quoted(cov.baseline)}, false) DESC, " if cov.baseline else ""
            ranked = f"SELECT level, row_number() OVER (ORDER BY {first}{order}, level) AS rank FROM (SELECT DISTINCT CAST({cov.col} AS VARCHAR) AS level FROM d_{tag})"
            levels.append(f"SELECT {k} AS k, rank, level, {quoted(cov.col + '=')} || level AS term FROM ({ranked}) WHERE rank > 1")
            values.append(f"SELECT id, j, CAST(1 AS DOUBLE) AS v FROM d_{tag} JOIN names_{tag} ON k = {k} AND level = CAST({cov.col} AS VARCHAR)")
        else:
            levels.append(f"SELECT {k} AS k, 0 AS rank, NULL AS level, {quoted(cov.col)} AS term")
            centred = f"CAST({cov.col} AS DOUBLE) - (SELECT avg({cov.col}) FROM d_{tag})"
            values.append(f"SELECT id, j, {centred} AS v FROM d_{tag} JOIN names_{tag} ON k = {k}")
    events = f"SELECT t, CAST(sum(s) AS BIGINT) AS m FROM d_{tag} GROUP BY t HAVING sum(s) > 0"
    return [
        f"d_{tag} AS MATERIALIZED (SELECT row_number() OVER () AS id, {time} AS t, {status} AS s, {', '.join(cols)} FROM {source} WHERE {whole})",
        f"names_{tag} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k, rank) AS j, * FROM ({' UNION ALL '.join(levels)}))",
        f"x_{tag} AS MATERIALIZED ({' UNION ALL '.join(values)})",
        f"xc_{tag} AS (SELECT * FROM x_{tag} UNION ALL SELECT id, 0, CAST(1 AS DOUBLE) FROM d_{tag})",
        f"xx_{tag} AS MATERIALIZED (SELECT id, t, s, a.j AS i, b.j AS j, a.v * b.v AS v FROM xc_{tag} a JOIN xc_{tag} b USING (id) JOIN d_{tag} USING (id) WHERE a.j <= b.j)",
        f"ev_{tag} AS MATERIALIZED (SELECT t, unnest(range(0, m)) / m AS u FROM ({events}))",
        f"b_{tag}_0 AS MATERIALIZED (SELECT j, CAST(0 AS DOUBLE) AS b FROM names_{tag})",
    ]


def moments_sql(tag: str, k: int) -> list[str]:
    """CTEs of the sums at the coefficients b_<tag>_<k>: risk (t, i, j, s, e), den (t, u, den), mean (t, u, j, mean)."""
    step = f"{tag}_{k}"
    return [
        f"r_{step} AS MATERIALIZED (SELECT id, exp(sum(b * v)) AS r, sum(b * v) AS eta FROM (SELECT id, j, v FROM x_{tag} UNION ALL"
        f" SELECT id, j, 0 FROM d_{tag}, (SELECT min(j) AS j FROM names_{tag})) JOIN b_{step} USING (j) GROUP BY id)",
        f"c_{step} AS MATERIALIZED (SELECT t, i, j, sum(r * v) AS c, sum(s * r * v) AS d FROM xx_{tag} JOIN r_{step} USING (id) GROUP BY ALL)",
        f"risk_{step} AS MATERIALIZED (SELECT q.t, i, j, sum(c) AS s, sum(CASE WHEN c.t = q.t THEN d ELSE 0 END) AS e"
        f" FROM (SELECT DISTINCT t FROM ev_{tag}) q JOIN c_{step} c ON c.t >= q.t GROUP BY ALL)",
        f"den_{step} AS MATERIALIZED (SELECT t, u, s - u * e AS den FROM ev_{tag} JOIN risk_{step} USING (t) WHERE i = 0 AND j = 0)",
        f"mean_{step} AS MATERIALIZED (SELECT t, u, j, (s - u * e) / den AS mean FROM den_{step} JOIN risk_{step} USING (t) WHERE i = 0 AND j > 0)",
    ]


def cells_sql(tag: str, k: int, weight: str = "1", clock: str = "") -> str:
    """(i, j, v) of the upper information matrix, each event weighted by `weight`, a function of a column g of `clock`."""
    step = f"{tag}_{k}"
    join = f" JOIN {clock} USING (t)" if clock else ""
    return f"""SELECT i, j, sum(v) AS v FROM (
 SELECT i, j, sum((s - u * e) / den * {weight}) AS v FROM den_{step} JOIN risk_{step} USING (t){join} WHERE i > 0 GROUP BY i, j
 UNION ALL SELECT a.j, b.j, -sum(a.mean * b.mean * {weight}) FROM mean_{step} a JOIN mean_{step} b USING (t, u){join} WHERE a.j <= b.j GROUP BY a.j, b.j)
 GROUP BY i, j"""


def score_sql(tag: str, k: int, weight: str = "1", clock: str = "") -> str:
    """(j, v) of the score vector."""
    step = f"{tag}_{k}"
    join = f" JOIN {clock} USING (t)" if clock else ""
    return f"""SELECT j, sum(v) AS v FROM (
 SELECT j, v * {weight} AS v FROM x_{tag} JOIN d_{tag} USING (id){join} WHERE s = 1
 UNION ALL SELECT j, -mean * {weight} FROM mean_{step}{join} UNION ALL SELECT j, 0 FROM names_{tag}) GROUP BY j"""


def square_sql(cells: str, tag: str) -> str:
    """The symmetric matrix of upper cells as a list of rows."""
    both = f"SELECT i, j, v FROM {cells} UNION ALL SELECT j, i, v FROM {cells} WHERE i < j"
    whole = f"SELECT p.j AS i, q.j AS j, coalesce(v, 0) AS v FROM names_{tag} p CROSS JOIN names_{tag} q LEFT JOIN ({both}) b ON b.i = p.j AND b.j = q.j"
    return f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM ({whole}) GROUP BY i)"


def step_sql(tag: str, k: int) -> list[str]:
    """The moments, and `sol` with rows (j, step, var) and the log-likelihood `ll`, of step k."""
    step = f"{tag}_{k}"
    own = "[CASE WHEN q = i THEN CAST(1 AS DOUBLE) ELSE 0 END for q in range(1, len(m) + 1)]"
    wide = f"list_transform(m, lambda r, i: list_concat(r, [w[i]], {own}))"
    return [
        *moments_sql(tag, k),
        f"info_{step} AS MATERIALIZED ({cells_sql(tag, k)})",
        f"u_{step} AS MATERIALIZED ({score_sql(tag, k)})",
        f"wide_{step} AS MATERIALIZED (SELECT {wide} AS wide FROM ({square_sql(f'info_{step}', tag)}), (SELECT list(v ORDER BY j) AS w FROM u_{step}))",
        f"inv_{step} AS MATERIALIZED (SELECT {gauss_jordan('wide')} AS m FROM wide_{step})",
        f"sol_{step} AS MATERIALIZED (SELECT j, m[j][len(m) + 1] AS step, m[j][len(m) + 1 + j] AS var FROM names_{tag}, inv_{step})",
        f"ll_{step} AS MATERIALIZED (SELECT (SELECT sum(eta) FROM r_{step} JOIN d_{tag} USING (id) WHERE s = 1) - sum(ln(den)) AS ll FROM den_{step})",
    ]


def fit_sql(tag: str, source: str, time: str, status: str, covariates: Sequence[Covariate], steps: int = STEPS) -> str:
    """All CTEs of a fit; its last coefficients are b_<tag>_<steps>."""
    parts = design_sql(tag, source, time, status, covariates)
    for k in range(steps + 1):
        parts += step_sql(tag, k)
        if k < steps:
            parts.append(f"b_{tag}_{k + 1} AS MATERIALIZED (SELECT j, b + step AS b FROM b_{tag}_{k} JOIN sol_{tag}_{k} USING (j))")
    # Estimates of a fit that has not settled are not comparable, so they are not shown.
    parts.append(f"ok_{tag} AS MATERIALIZED (SELECT coalesce(max(abs(step)) < 1e-6, false) AS ok FROM sol_{tag}_{steps})")
    return ",\n".join(parts)


def summary_sql(tag: str, steps: int = STEPS, first: str = "", digits: int = 6, z_digits: int = 6, sizes: bool = True) -> str:
    """The coefficients of a fit with error, z, p and 95 % limits."""
    size = f", (SELECT count(*) FROM d_{tag}) AS n, (SELECT CAST(sum(s) AS BIGINT) FROM d_{tag}) AS n_event, (SELECT ok FROM ok_{tag}) AS converged" if sizes else ""
    return f"""SELECT {first}term, round(b, {digits}) AS coef, round(exp(b), {digits}) AS exp_coef, round(se, {digits}) AS se, round(b / se, {z_digits}) AS z,
 CASE WHEN b IS NOT NULL THEN round({tail("(b / se) ** 2", "1")}, {digits}) END AS p, round(exp(b - {Z95!r} * se), {digits}) AS lower, round(exp(b + {Z95!r} * se), {digits}) AS upper{size}
FROM (SELECT term, CASE WHEN ok THEN b END AS b, CASE WHEN ok THEN sqrt(var) END AS se FROM ok_{tag}, names_{tag} JOIN b_{tag}_{steps} USING (j) JOIN sol_{tag}_{steps} USING (j))"""


def tests_ctes(tag: str, steps: int = STEPS) -> str:
    """The three global tests of a fit and its comparable pairs."""
    last, zero = f"{tag}_{steps}", f"{tag}_0"
    both = f"SELECT i, j, v FROM info_{last} UNION ALL SELECT j, i, v FROM info_{last} WHERE i < j"
    wald = f"SELECT sum(a.b * c.b * v) FROM ({both}) q JOIN b_{last} a ON a.j = q.i JOIN b_{last} c ON c.j = q.j"
    return f"""scored_{tag} AS MATERIALIZED (SELECT t, s, round(eta, 12) AS eta FROM d_{tag} JOIN r_{last} USING (id)),
pairs_{tag} AS (SELECT CASE WHEN a.eta > b.eta THEN 1.0 WHEN a.eta = b.eta THEN 0.5 ELSE 0.0 END AS c
 FROM scored_{tag} a JOIN scored_{tag} b ON a.s = 1 AND (b.t > a.t OR (b.t = a.t AND b.s = 0))),
tests_{tag} AS (SELECT (SELECT count(*) FROM names_{tag}) AS df, z.ll AS loglik0, CASE WHEN ok THEN e.ll END AS loglik,
 CASE WHEN ok THEN 2 * (e.ll - z.ll) END AS lrt, CASE WHEN ok THEN ({wald}) END AS wald, ok,
 (SELECT sum(step * v) FROM sol_{zero} JOIN u_{zero} USING (j)) AS score FROM ll_{zero} z, ll_{last} e, ok_{tag})"""


def tests_select(tag: str, first: str = "") -> str:
    return f"""SELECT {first}(SELECT count(*) FROM d_{tag}) AS n, (SELECT CAST(sum(s) AS BIGINT) FROM d_{tag}) AS n_event, CAST(df AS INT) AS df,
 round(loglik0, 6) AS loglik0, round(loglik, 6) AS loglik, round(lrt, 6) AS lrt, CASE WHEN ok THEN round({tail("lrt", "df")}, 6) END AS lrt_p, round(wald, 6) AS wald,
 CASE WHEN ok THEN round({tail("wald", "df")}, 6) END AS wald_p, round(score, 6) AS score, round({tail("score", "df")}, 6) AS score_p,
 CASE WHEN ok THEN (SELECT round(avg(c), 6) FROM pairs_{tag}) END AS concordance, ok AS converged FROM tests_{tag}"""


def zph_sql(tag: str, covariates: Sequence[Covariate], steps: int = STEPS, digits: int = 6) -> str:
    """The score test of drifting coefficients against 1 - S(t-), by term and for all."""
    clock = f"""kt_{tag} AS (SELECT t, count(*) AS n, sum(s) AS d FROM d_{tag} GROUP BY t),
kr_{tag} AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS n_risk FROM kt_{tag}),
clock_{tag} AS MATERIALIZED (SELECT t, 1 - coalesce(product(1 - d / n_risk) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM kr_{tag})"""
    parts = [clock]
    for k in (1, 2):
        parts.append(f"drift_{tag}_{k} AS MATERIALIZED ({cells_sql(tag, steps, f'g ** {k}', f'clock_{tag}')})")
        parts.append(f"wide_{tag}_d{k} AS MATERIALIZED ({square_sql(f'drift_{tag}_{k}', tag)})")
    parts.append(f"shift_{tag} AS (SELECT list(v ORDER BY j) AS w FROM ({score_sql(tag, steps, 'g', f'clock_{tag}')}))")
    # What is left of the drift once the coefficients have taken their share.
    taken = "list_sum(list_transform(a1[i], lambda y, c: y * list_sum(list_transform(a1, lambda row, d: inv[c][d] * row[j]))))"
    left = f"list_transform(a2, lambda r, i: list_transform(r, lambda v, j: v - {taken}))"
    inverse = f"SELECT list_transform(m, lambda r, i: r[len(m) + 2 : 2 * len(m) + 1]) AS inv FROM inv_{tag}_{steps}"
    parts.append(f"""left_{tag} AS MATERIALIZED (SELECT {left} AS rest, w FROM ({inverse}), shift_{tag},
 (SELECT m AS a1 FROM wide_{tag}_d1), (SELECT m AS a2 FROM wide_{tag}_d2))""")
    name = "CASE k " + " ".join(f"WHEN {k} THEN {quoted(c.col)}" for k, c in enumerate(covariates)) + " END"
    groups = f"SELECT {name} AS term, list(j ORDER BY j) AS places FROM names_{tag} GROUP BY k UNION ALL SELECT 'GLOBAL', list(j ORDER BY j) FROM names_{tag}"
    sub = "list_transform(places, lambda i: list_concat(list_transform(places, lambda j: rest[i][j]), [w[i]]))"
    parts.append(f"sub_{tag} AS MATERIALIZED (SELECT term, places, w, {sub} AS sub FROM ({groups}), left_{tag})")
    parts.append(f"solved_{tag} AS MATERIALIZED (SELECT term, places, w, {gauss_jordan('sub')} AS m FROM sub_{tag})")
    chisq = "list_sum(list_transform(places, lambda c, i: w[c] * m[i][len(m) + 1]))"
    shown = f"SELECT term, CASE WHEN ok THEN {chisq} END AS chisq, CAST(len(places) AS INT) AS df FROM solved_{tag}, ok_{tag}"
    return ",\n".join(parts) + f"\nSELECT term, round(chisq, {digits}) AS chisq, df, CASE WHEN chisq IS NOT NULL THEN round({tail('chisq', 'df')}, {digits}) END AS p FROM ({shown})"
