"""Descriptive tables and running totals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import describe as ds
from cohortline.operators.ordered import count_ranges, running_totals


def test_crosstab_keeps_zero_cells(spark):
    rows = [("Initial", "a"), ("Return", "b"), (None, "a"), ("Return", None)]
    df = spark.createDataFrame(rows, "t string, v string")
    out = sorted(tuple(r) for r in ds.crosstab_counts(df, "t", "v").collect())
    assert out == [("Initial", "a", 1), ("Initial", "b", 0), ("Return", "a", 0), ("Return", "b", 1)]


@pytest.mark.parametrize("sorted_rows", [10**6, 1])
def test_six_number(spark, sorted_rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert tuple(ds.six_number(df, "x", sorted_rows).first()) == (1.0, 1.75, 2.5, 2.5, 3.25, 4.0, 1)


@pytest.mark.parametrize("sorted_rows", [10**6, 25])
def test_six_number_with_most_rows_on_one_value(spark, sorted_rows):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(900) < 0.4, 7.25, np.round(rng.lognormal(2, 1, 900), 3))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = ds.six_number(df, "x", sorted_rows).first()
    want = [x.min(), *np.quantile(x, [0.25, 0.5]), x.mean(), np.quantile(x, 0.75), x.max()]
    assert list(got)[:6] == pytest.approx(want, rel=1e-12)


def test_six_number_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert tuple(ds.six_number(df, "x").first()) == (None, None, None, None, None, None, 2)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_ranges(spark, descending):
    rng = np.random.default_rng(7)
    rows = [(f"g{k}", float(v), int(n)) for k in range(3) for v, n in zip(rng.permutation(200), rng.integers(1, 9, 200))]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(6).cache()
    ranges = count_ranges(df, 60)
    assert ranges == 10
    whole = running_totals(df, "v", {"n": "t"}, ["g"], 1, descending)
    split = running_totals(df, "v", {"n": "t"}, ["g"], ranges, descending)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))


def test_frequencies_and_rates(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 2), ("y", 2)], "a string, b int")
    assert sorted(map(tuple, ds.freq(df, "a").collect())) == [("x", 2), ("y", 1)]
    assert sorted(map(tuple, ds.freq_many(df, ["a", "b"]).collect())) == [
        ("a", "x", 2), ("a", "y", 1), ("b", "1", 1), ("b", "2", 2),
    ]
    assert tuple(ds.rate(df, F.col("b") == 2, "two").first()) == ("two", 3, 2, 2 / 3)
    assert tuple(ds.rate(df, F.col("b") == 2, "two", missing_is_no=True).first()) == ("two", 4, 2, 0.5)
    both = ds.rates(df, {"two": F.col("b") == 2, "x": F.col("a") == "x"}).collect()
    assert [tuple(r) for r in both] == [("two", 3, 2, 2 / 3), ("x", 3, 2, 2 / 3)]
    assert tuple(ds.ratio(df, "a", "x", "y").first()) == (2, 1, 2.0)
    assert sorted(map(tuple, ds.share(df, "a").collect())) == [("x", 2, 2 / 3), ("y", 1, 1 / 3)]


def test_crosstab_of_many_columns(spark):
    df = spark.range(24_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS t", "cast(id % 12000 as string) AS v")
    out = ds.crosstab_counts(df, "t", "v")
    assert out.count() == 24_000 and out.agg({"n": "sum"}).first()[0] == 24_000


def test_grid_in_blocks(spark):
    """12,000 levels, no row of which holds more than a block of them."""
    df = spark.range(24_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' WHEN id % 11 = 0 THEN NULL ELSE 'b' END AS t", "CAST(id DIV 2 AS STRING) AS v")
    out = ds.crosstab_counts(df, "t", "v")
    assert out.count() == 24_000 and out.agg({"n": "sum"}).first()[0] == df.where("t IS NOT NULL").count()
    assert out.where("n = 0").count() == 24_000 - df.where("t IS NOT NULL").count()
    plain = ds.crosstab_counts(df.where("v < 30"), "t", "v", block=7)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ds.crosstab_counts(df.where("v < 30"), "t", "v", block=10**6).collect()))
    blocks = ds._grid(df.select(ds.F.col("t").alias("row")).distinct(), df.select(ds.F.col("v").alias("column")).distinct(), 1_000)
    assert "CartesianProduct" not in blocks._jdf.queryExecution().toString() and "NestedLoop" not in blocks._jdf.queryExecution().toString()


def test_crosstabs_in_one_pass(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", None), (None, "x", 1), ("a", "x", 2)], "t string, u string, v int")
    out = sorted(tuple(r) for r in ds.crosstabs(df, "t", {"u": ["x", "y"], "v": [1, 2, 3]}).collect())
    want = [("u", "a", "x", 2), ("u", "a", "y", 0), ("u", "b", "x", 0), ("u", "b", "y", 1), ("v", "a", "1", 1), ("v", "a", "2", 2), ("v", "a", "3", 0)]
    assert out == want and ds.crosstabs(df.limit(0), "t", {"u": ["x"]}).count() == 0
