"""Cox models on customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cox as cx, wide_cox as wx
from .base import query, rounded, with_patients
from .cox_sql import fit_sql, summary_sql, tail
from .survival import months

BALANCE = cx.Covariate("balance")
MANY = cx.Covariate("many", "category")
SEGMENT = cx.Covariate("c_mktsegment", "category")
_STEPS = 7


def _people(spark, sf):
    return months(spark, sf).withColumns(
        {
            "balance": F.col("c_acctbal") / 1000,
            "many": F.when(F.col("n_orders") > 10, "yes").otherwise("no"),
        }
    )


def _fit(spark, sf, *covariates):
    return cx.coxph(_people(spark, sf), "months", "status", covariates)


_X = {"balance": "c_acctbal / 1000", "many=yes": "CASE WHEN n_orders > 10 THEN 1.0 ELSE 0.0 END"}


def _moments_sql(tag: str, k: int, p: int) -> str:
    """CTE `ev_<tag>_<k>`: one row per event time and tied event l, at beta `b_<tag>_<k>`."""
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    sums = ["sum(r) AS s0", "sum(s * r) AS e0", "CAST(sum(s) AS BIGINT) AS m", f"sum(s * ({eta})) AS zb"]
    keep = ["s0"]
    for i in range(p):
        sums += [f"sum(r * x{i}) AS s1_{i}", f"sum(s * r * x{i}) AS e1_{i}", f"sum(s * x{i}) AS z_{i}"]
        keep.append(f"s1_{i}")
        for j in range(i, p):
            sums += [f"sum(r * x{i} * x{j}) AS s2_{i}{j}", f"sum(s * r * x{i} * x{j}) AS e2_{i}{j}"]
            keep.append(f"s2_{i}{j}")
    running = ", ".join(f"sum({c}) OVER (ORDER BY t DESC) AS {c}" for c in keep)
    rest = ["t", "e0", "m", "zb"]
    for i in range(p):
        rest += [f"e1_{i}", f"z_{i}", *[f"e2_{i}{j}" for j in range(i, p)]]
    step = f"{tag}_{k}"
    return f"""bt_{step} AS MATERIALIZED (SELECT t, {", ".join(sums)}
 FROM (SELECT d_{tag}.*, b_{step}.*, exp({eta}) AS r FROM d_{tag}, b_{step}) GROUP BY t),
rs_{step} AS MATERIALIZED (SELECT {", ".join(rest)}, {running} FROM bt_{step}),
ev_{step} AS MATERIALIZED (SELECT *, f / m AS u FROM (SELECT *, unnest(range(0, m)) AS f FROM rs_{step} WHERE m > 0))"""


def _mean(i: int) -> str:
    return f"((s1_{i} - u * e1_{i}) / (s0 - u * e0))"


def _variance(i: int, j: int) -> str:
    return f"((s2_{i}{j} - u * e2_{i}{j}) / (s0 - u * e0) - {_mean(i)} * {_mean(j)})"


def _sums_sql(tag: str, k: int, p: int) -> str:
    step = f"{tag}_{k}"
    cols = ["sum(zb / m) - sum(ln(s0 - u * e0)) AS ll"]
    cols += [f"sum(z_{i} / m - {_mean(i)}) AS u{i}" for i in range(p)]
    cols += [f"sum({_variance(i, j)}) AS i{i}{j}" for i in range(p) for j in range(i, p)]
    return f"{_moments_sql(tag, k, p)},\nsum_{step} AS MATERIALIZED (SELECT {', '.join(cols)} FROM ev_{step})"


def newton_sql(tag: str, xs: list[str], steps: int = _STEPS) -> str:
    """Newton's method written out; the last state is `b_<tag>_<steps>`, `sum_<tag>_<steps>`."""
    p = len(xs)
    design = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))
    parts = [
        f"d_{tag} AS MATERIALIZED (SELECT months AS t, status AS s, {design} FROM pat"
        f" WHERE months IS NOT NULL AND status IS NOT NULL AND c_acctbal IS NOT NULL)",
        f"b_{tag}_0 AS (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(p))})",
    ]
    for k in range(steps + 1):
        parts.append(_sums_sql(tag, k, p))
        if k == steps:
            break
        if p == 1:
            new = "b0 + u0 / i00 AS b0"
        else:
            det = "(i00 * i11 - i01 * i01)"
            new = f"b0 + (i11 * u0 - i01 * u1) / {det} AS b0, b1 + (i00 * u1 - i01 * u0) / {det} AS b1"
        parts.append(f"b_{tag}_{k + 1} AS MATERIALIZED (SELECT {new} FROM b_{tag}_{k}, sum_{tag}_{k})")
    return ",\n".join(parts)


def _coefficients_sql(tag: str, names: list[str], steps: int = _STEPS) -> str:
    p = len(names)
    state = f"b_{tag}_{steps}, sum_{tag}_{steps}"
    var = ["1 / i00"] if p == 1 else [f"{d} / (i00 * i11 - i01 * i01)" for d in ("i11", "i00")]
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS term, b{i} AS b, sqrt({var[i]}) AS se FROM {state}" for i, n in enumerate(names)
    )
    return f"""SELECT term, round(b, 6) AS coef, round(exp(b), 6) AS exp_coef, round(se, 6) AS se, round(b / se, 5) AS z, round({tail("(b / se) ** 2", "1")}, 6) AS p,
 round(exp(b - 1.959963984540054 * se), 6) AS lower, round(exp(b + 1.959963984540054 * se), 6) AS upper FROM ({rows})"""


_BOTH = list(_X)
_BOTH_SQL = ", " + newton_sql("f", [_X[n] for n in _BOTH])


def _shown(df, *first):
    cols = ["coef", "exp_coef", "se", "p", "lower", "upper"]
    return rounded(rounded(df.select(*first, "term", *cols, "z"), *cols), "z", digits=5)


@query("cox_fit", with_patients(f"{_BOTH_SQL}\n{_coefficients_sql('f', _BOTH)}"))
def cox_fit(spark, sf):
    return _shown(cx.cox_summary(_fit(spark, sf, BALANCE, MANY)))


_WALD = "(b0 * b0 * i00 + 2 * b0 * b1 * i01 + b1 * b1 * i11)"
_SCORE = "((i11 * u0 * u0 - 2 * i01 * u0 * u1 + i00 * u1 * u1) / (i00 * i11 - i01 * i01))"


@query(
    "cox_summary",
    with_patients(f"""{_BOTH_SQL},
scored AS (SELECT t, s, round(b0 * x0 + b1 * x1, 12) AS eta FROM d_f, b_f_{_STEPS}),
pairs AS (SELECT CASE WHEN a.eta > b.eta THEN 1.0 WHEN a.eta = b.eta THEN 0.5 ELSE 0.0 END AS c
 FROM scored a JOIN scored b ON a.s = 1 AND (b.t > a.t OR (b.t = a.t AND b.s = 0))),
tests AS (SELECT z.ll AS loglik0, e.ll AS loglik, 2 * (e.ll - z.ll) AS lrt,
 (SELECT {_WALD} FROM b_f_{_STEPS}, sum_f_{_STEPS}) AS wald, (SELECT {_SCORE} FROM sum_f_0) AS score FROM sum_f_0 z, sum_f_{_STEPS} e)
SELECT (SELECT count(*) FROM d_f) AS n, (SELECT CAST(sum(s) AS BIGINT) FROM d_f) AS n_event, CAST(2 AS INT) AS df,
 round(loglik0, 6) AS loglik0, round(loglik, 6) AS loglik, round(lrt, 6) AS lrt, round(wald, 6) AS wald, round(score, 6) AS score,
 round({tail("lrt", "2")}, 6) AS lrt_p, round({tail("wald", "2")}, 6) AS wald_p, round({tail("score", "2")}, 6) AS score_p,
 (SELECT round(avg(c), 6) FROM pairs) AS concordance, true AS converged
FROM tests"""),
)
def cox_summary(spark, sf):
    tests = cx.cox_tests(_fit(spark, sf, BALANCE, MANY))
    shown = ["loglik0", "loglik", "lrt", "lrt_p", "wald", "wald_p", "score", "score_p", "concordance"]
    return rounded(tests.select("n", "n_event", "df", *shown, "converged"), *shown)


@query(
    "cox_table",
    with_patients(
        ", "
        + newton_sql("a", [_X["balance"]])
        + ", "
        + newton_sql("m", [_X["many=yes"]])
        + f"\nSELECT 'balance' AS model, * FROM ({_coefficients_sql('a', ['balance'])})"
        + f" UNION ALL SELECT 'many' AS model, * FROM ({_coefficients_sql('m', ['many=yes'])})"
    ),
)
def cox_table(spark, sf):
    people = _people(spark, sf)
    fits = {c.col: cx.coxph(people, "months", "status", [c]) for c in (BALANCE, MANY)}
    return _shown(cx.cox_table(fits), "model")


@query(
    "cox_segment",
    with_patients(f", {fit_sql('g', 'pat', 'months', 'status', [SEGMENT])}\n{summary_sql('g', z_digits=5, sizes=False)}"),
)
def cox_segment(spark, sf):
    return _shown(cx.cox_summary(_fit(spark, sf, SEGMENT)))


_AT = "SELECT CAST(0.3 AS DOUBLE) AS b0"


@query(
    "cox_loglik_at",
    with_patients(f""", d_l AS (SELECT months AS t, status AS s, {_X["many=yes"]} AS x0 FROM pat WHERE months IS NOT NULL),
b_l_0 AS ({_AT}),
{_sums_sql("l", 0, 1)}
SELECT round(ll, 6) AS loglik, round(u0, 6) AS score FROM sum_l_0"""),
)
def cox_loglik_at(spark, sf):
    out = cx.cox_loglik_at(_people(spark, sf), "months", "status", [MANY], [0.3])
    return rounded(out.withColumnRenamed("score_many=yes", "score"), "loglik", "score")


@query(
    "cox_score_at_zero",
    with_patients(f""", d_z AS (SELECT months AS t, status AS s, {_X["many=yes"]} AS x0 FROM pat WHERE months IS NOT NULL),
b_z_0 AS (SELECT CAST(0 AS DOUBLE) AS b0),
{_sums_sql("z", 0, 1)}
SELECT round(u0, 6) AS score, round(i00, 6) AS information, round(u0 * u0 / i00, 6) AS chisq FROM sum_z_0"""),
)
def cox_score_at_zero(spark, sf):
    out = cx.cox_score_at_zero(_people(spark, sf), "months", "status", MANY)
    return rounded(out, "score", "information", "chisq")


_CLOCK_SQL = """kt AS (SELECT t, count(*) AS n, sum(s) AS d FROM d_f GROUP BY t),
kr AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS n_risk FROM kt),
clock AS (SELECT t AS ct, 1 - coalesce(product(1 - d / n_risk) OVER (
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM kr)"""


def _zph_sql() -> str:
    step = f"f_{_STEPS}"
    cols = ["sum(g) / count(*) AS gm"]
    for k in (0, 1):
        cols += [f"sum((z_{i} / m - {_mean(i)}) * g ** {k}) AS u{i}_{k}" for i in (0, 1)]
    for k in (0, 1, 2):
        cols += [f"sum({_variance(i, j)} * g ** {k}) AS v{i}{j}_{k}" for i, j in ((0, 0), (0, 1), (1, 1))]
    pairs = ("00", "01", "11")
    centred = [f"u{i}_1 - gm * u{i}_0 AS w{i}" for i in (0, 1)]
    centred += [f"v{q}_0 AS a{q}" for q in pairs]
    centred += [f"v{q}_1 - gm * v{q}_0 AS c{q}" for q in pairs]
    centred += [f"v{q}_2 - 2 * gm * v{q}_1 + gm * gm * v{q}_0 AS e{q}" for q in pairs]
    det = "(a00 * a11 - a01 * a01)"
    col = {0: ("c00", "c01"), 1: ("c01", "c11")}

    def left(i, j):
        (x0, x1), (y0, y1) = col[i], col[j]
        return f"(e{i}{j} - ({x0} * {y0} * a11 - ({x0} * {y1} + {x1} * {y0}) * a01 + {x1} * {y1} * a00) / {det})"

    parts = ", ".join(f"{left(i, j)} AS l{i}{j}" for i, j in ((0, 0), (0, 1), (1, 1)))
    both = "(l11 * w0 * w0 - 2 * l01 * w0 * w1 + l00 * w1 * w1) / (l00 * l11 - l01 * l01)"
    return f"""{_CLOCK_SQL},
zs AS (SELECT {", ".join(cols)} FROM ev_{step} JOIN clock ON ct = t),
zc AS (SELECT {", ".join(centred)} FROM zs),
zl AS (SELECT w0, w1, {parts} FROM zc)
SELECT 'balance' AS term, round(w0 * w0 / l00, 5) AS chisq, CAST(1 AS INT) AS df FROM zl
UNION ALL SELECT 'many', round(w1 * w1 / l11, 5), CAST(1 AS INT) FROM zl
UNION ALL SELECT 'GLOBAL', round({both}, 5), CAST(2 AS INT) FROM zl"""


@query("cox_zph", with_patients(f"{_BOTH_SQL}, {_zph_sql()}"))
def cox_zph(spark, sf):
    return rounded(cx.cox_zph(_fit(spark, sf, BALANCE, MANY)).select("term", "chisq", "df"), "chisq", digits=5)


def _residual_sql() -> str:
    step = f"f_{_STEPS}"
    means = ", ".join(f"avg({_mean(i)}) AS m{i}" for i in (0, 1))
    det = "(i00 * i11 - i01 * i01)"
    scaled = [f"b0 + ne * (i11 * r0 - i01 * r1) / {det}", f"b1 + ne * (i00 * r1 - i01 * r0) / {det}"]
    arms = " UNION ALL ".join(
        f"SELECT t AS time, '{n}' AS term, round(r{i}, 5) AS residual, round({scaled[i]}, 4) AS scaled, n"
        f" FROM rr, b_{step}, sum_{step}"
        for i, n in enumerate(_BOTH)
    )
    return f"""mm AS (SELECT t AS mt, {means} FROM ev_{step} GROUP BY t),
rr AS (SELECT t, x0 - m0 AS r0, x1 - m1 AS r1, n, (SELECT sum(s) FROM d_f) AS ne
 FROM (SELECT t, x0, x1, count(*) AS n FROM d_f WHERE s = 1 GROUP BY t, x0, x1) JOIN mm ON mt = t)
{arms}"""


@query("schoenfeld_residuals", with_patients(f"{_BOTH_SQL}, {_residual_sql()}"))
def schoenfeld_residuals(spark, sf):
    out = cx.schoenfeld_residuals(_fit(spark, sf, BALANCE, MANY))
    return rounded(rounded(out, "residual", digits=5), "scaled", digits=4)


@query(
    "encode",
    with_patients("""SELECT hosp_id, """ + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS {s.lower()}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")
    ) + " FROM pat"),
)
def encode(spark, sf):
    people = months(spark, sf)
    dummies = cx.encode(people, "c_mktsegment", "HOUSEHOLD")
    return people.select("hosp_id", *[v.alias(n.split("=")[1].lower()) for n, v in dummies.items()])


NATION = cx.Covariate("c_nationkey", "category")
BALANCE_RAW = cx.Covariate("c_acctbal")
_NATIONS = f""", nat AS MATERIALIZED (SELECT pat.*, c_nationkey FROM pat JOIN customer ON c_custkey = hosp_id),
{fit_sql('w', 'nat', 'months', 'status', [NATION, BALANCE_RAW])}
SELECT term, CASE WHEN ok THEN round(b, 6) END AS coef, CASE WHEN ok THEN round(exp(b), 6) END AS exp_coef FROM ok_w, names_w JOIN b_w_7 USING (j)"""


@query("cox_wide", with_patients(_NATIONS))
def cox_wide(spark, sf):
    """Levels as numbers in a table, Newton's equations by conjugate gradients."""
    nations = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    people = months(spark, sf).join(nations, F.col("hosp_id") == F.col("c_custkey"))
    fit = wx.coxph_wide(people, "months", "status", [NATION, BALANCE_RAW])
    found = wx.wide_coefficients(fit)
    # Estimates of a fit that has not settled are not comparable, so they are not shown.
    return rounded(found.withColumns({c: F.when(F.lit(fit.converged), F.col(c)) for c in ("coef", "exp_coef")}), "coef", "exp_coef")


@query(
    "encode_levels",
    with_patients(""", levels AS (SELECT DISTINCT c_mktsegment AS level FROM pat WHERE c_mktsegment IS NOT NULL)
SELECT hosp_id, number FROM pat LEFT JOIN (SELECT level, row_number() OVER (ORDER BY level <> 'HOUSEHOLD', level) - 1 AS number FROM levels)
 ON level = c_mktsegment"""),
)
def encode_levels(spark, sf):
    people = months(spark, sf)
    numbers = wx.number_levels(people, "c_mktsegment", "HOUSEHOLD")
    return wx.encode_levels(people, "c_mktsegment", numbers, "number").select("hosp_id", "number")
