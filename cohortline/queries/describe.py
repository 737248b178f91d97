"""Descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as c, dates
from ..operators import describe as ds
from ..plans import dictionaries as d
from ..plans.bindings import enc, patients, registry_rows, table
from .base import query, rounded, with_enc, with_patients, with_registry


@query(
    "freq",
    with_enc("SELECT regimen_a AS value, count(*) AS n FROM enc WHERE regimen_a IS NOT NULL GROUP BY 1"),
)
def freq(spark, sf):
    return ds.freq(enc(spark, sf), "regimen_a")


_FREQ = ["encounter_type", "outcome", "ecog_index", "bleeding_site", "swelling_site", "regimen_a", "regimen_b", "remission_plan"]


@query(
    "freq_many",
    with_enc(
        " UNION ALL ".join(
            f"SELECT '{col}' AS \"column\", CAST({col} AS VARCHAR) AS value, count(*) AS n FROM enc"
            f" WHERE {col} IS NOT NULL GROUP BY 2"
            for col in _FREQ
        )
    ),
)
def freq_many(spark, sf):
    return ds.freq_many(enc(spark, sf), _FREQ)


@query(
    "crosstab_counts",
    with_enc(""", t AS (SELECT encounter_type AS r, CASE WHEN hgb < 10 THEN '< 10' WHEN hgb >= 10 THEN '>=10' END AS c
 FROM enc WHERE encounter_type IS NOT NULL AND hgb IS NOT NULL)
SELECT a.r AS "row", b.c AS "column", (SELECT count(*) FROM t WHERE t.r = a.r AND t.c = b.c) AS n
FROM (SELECT DISTINCT r FROM t) a, (SELECT DISTINCT c FROM t) b"""),
)
def crosstab_counts(spark, sf):
    anemia = c.band(F.col("hgb"), d.HGB_CUT, "< 10", ">=10", False)
    rows = enc(spark, sf).select("encounter_type", anemia.alias("anemia"))
    return ds.crosstab_counts(rows, "encounter_type", "anemia")


def _six_sql(col: str, source: str) -> str:
    return f"""SELECT min({col}) AS minimum, round(quantile_cont({col}, 0.25), 6) AS q1,
 round(quantile_cont({col}, 0.5), 6) AS median, round(avg({col}), 6) AS mean,
 round(quantile_cont({col}, 0.75), 6) AS q3, max({col}) AS maximum, count(*) - count({col}) AS n_missing
FROM {source}"""


_SIX = ["q1", "median", "mean", "q3"]


@query("six_number", with_enc(_six_sql("creatinine_raw", "enc")))
def six_number(spark, sf):
    return rounded(ds.six_number(enc(spark, sf), "creatinine_raw"), *_SIX)


@query("six_number_months", with_patients(_six_sql("months", "pat")))
def six_number_months(spark, sf):
    months = dates.survival_time(F.col("start_date"), F.col("end_date"))
    return rounded(ds.six_number(patients(spark, sf).select(months.alias("months")), "months"), *_SIX)


@query("six_number_price", _six_sql("l_extendedprice", "lineitem"))
def six_number_price(spark, sf):
    return rounded(ds.six_number(table(spark, sf, "lineitem"), "l_extendedprice"), *_SIX)


_CONDS = {
    "renal_failure": "creatinine_raw > 177",
    "anemia": "hgb < 10",
    "hypercalcemia": "calcium > 2.75",
    "on_remission": "on_remission",
    "initial": "encounter_type = 'Initial'",
    "deceased": "lower(outcome) = 'deceased'",
}


@query(
    "rates",
    with_registry(
        " UNION ALL ".join(
            f"SELECT '{n}' AS indicator, count({e}) AS n, CAST(coalesce(sum(CAST({e} AS INT)), 0) AS BIGINT) AS n_true,"
            f" round(avg(CAST({e} AS INT)), 6) AS share FROM reg"
            for n, e in _CONDS.items()
        )
    ),
)
def rates(spark, sf):
    return rounded(ds.rates(registry_rows(spark, sf), {n: F.expr(e) for n, e in _CONDS.items()}), "share")


@query(
    "rate_missing_is_no",
    with_registry("""SELECT 'anemia' AS indicator, count(*) AS n, count(CASE WHEN hgb < 10 THEN 1 END) AS n_true,
 round(count(CASE WHEN hgb < 10 THEN 1 END) / count(*), 6) AS share FROM reg"""),
)
def rate_missing_is_no(spark, sf):
    out = ds.rate(registry_rows(spark, sf), F.col("hgb") < 10, "anemia", missing_is_no=True)
    return rounded(out, "share")


@query(
    "ratio",
    with_registry("""SELECT count(CASE WHEN outcome = 'Alive' THEN 1 END) AS n_a,
 count(CASE WHEN outcome = 'LTFU' THEN 1 END) AS n_b,
 round(count(CASE WHEN outcome = 'Alive' THEN 1 END) / count(CASE WHEN outcome = 'LTFU' THEN 1 END), 6) AS ratio
FROM reg"""),
)
def ratio(spark, sf):
    return rounded(ds.ratio(registry_rows(spark, sf), "outcome", "Alive", "LTFU"), "ratio")


@query(
    "share",
    with_registry("""SELECT birth_year AS value, count(*) AS n,
 round(count(*) / (SELECT count(birth_year) FROM reg), 6) AS share FROM reg WHERE birth_year IS NOT NULL GROUP BY 1"""),
)
def share(spark, sf):
    return rounded(ds.share(registry_rows(spark, sf), "birth_year"), "share")
