"""Cox regression on categories with very many levels.

Levels are numbered in a table and a row holds its non-zero covariates as (number, value), so neither the plan nor a row grows with the
levels. The information matrix is never formed. Its product with a vector takes two passes over the reduced rows: sums per
time with running totals (a scalar each, whatever the number of levels), and, with those joined back, sums per covariate. Newton's
equations are solved by conjugate gradients on such products, scaled by the diagonal. The driver holds a few vectors of one number per
covariate, 8 bytes a level; names stay in the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .cox import STEP_TOL, Covariate, _tied_sums, model_frame
from .durable import durable
from .ordered import SORTED_ROWS, count_ranges, running_totals

#: What conjugate gradients leave of an equation at the end and at most, as a share of its right side, and their most products.
SOLVED, ROUGHLY = 1e-11, 1e-2
PRODUCTS = 500


def number_levels(
    df: DataFrame, col: str, baseline: str | None = None, levels: Sequence[str] = (), sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """(level, number) of the levels that occur: the reference is 0, the others follow in order.

    The reference is `baseline`, or else the first of `levels`, or of the sorted levels. A missing value is no level.
    """
    level = F.col(col).cast("string")
    found = durable(df.where(level.isNotNull()).select(level.alias("level")).distinct())
    listed = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("level")) if levels else F.lit(0)
    place = F.struct(
        F.coalesce(F.col("level") != F.lit(baseline), F.lit(True)).alias("other"), (listed == 0).alias("unlisted"), listed.alias("listed"), "level"
    )
    ordered = found.select("level", place.alias("place"), F.lit(1).cast("long").alias("one"))
    ranked = running_totals(ordered, "place", {"one": "upto"}, ranges=count_ranges(found, sorted_rows))
    return ranked.select("level", (F.col("upto") - 1).alias("number"))


def encode_levels(df: DataFrame, col: str, numbers: DataFrame, out: str) -> DataFrame:
    """Add the number of each row's level; a missing or unknown value has none. Spark broadcasts the table if it is small."""
    named = numbers.select(F.col("level").alias("_level"), F.col("number").alias(out))
    return df.join(named, F.col(col).cast("string") == F.col("_level"), "left").drop("_level")


@dataclass
class WideFit:
    """A fitted model: names of the covariates in a table (j, term), estimates on the driver."""

    terms: DataFrame
    rows: DataFrame
    times: DataFrame
    ranges: int
    coef: np.ndarray
    loglik0: float
    loglik: float
    n: int
    n_event: int
    steps: int
    converged: bool


def _weighted(rows: DataFrame, vector: np.ndarray, out: str) -> DataFrame:
    """Add the product of each row's covariates with a vector, which comes as a table of one row."""
    one = rows.sparkSession.createDataFrame([(0, vector.tolist())], "model int, vec array<double>")
    product = F.expr("aggregate(cells, 0D, (acc, c) -> acc + c.v * vec[CAST(c.j AS INT)])")
    return rows.join(F.broadcast(one), "model").withColumn(out, product).drop("vec")


def _per_covariate(rows: DataFrame, size: int, sums: dict[str, str]) -> list[np.ndarray]:
    """For each of `sums`, an expression of a cell's value v and columns of its row, the total by covariate."""
    names = list(sums)
    cells = rows.selectExpr("*", "explode(cells) AS c").selectExpr("*", "c.j AS j", "c.v AS v")
    found = cells.groupBy("j").agg(*[F.expr(f"sum({e}) AS {n}") for n, e in sums.items()]).collect()
    out = [np.zeros(size) for _ in names]
    for r in found:
        for vector, name in zip(out, names, strict=True):
            vector[r["j"]] = r[name]
    return out


def _spread(times: DataFrame, ranges: int) -> DataFrame:
    """Up to SORTED_ROWS distinct times are broadcast."""
    return F.broadcast(times) if ranges == 1 else times


def _state(design: DataFrame, beta: np.ndarray, ranges: int, ties: str) -> tuple[DataFrame, DataFrame, float]:
    """(rows with risk weights and the sums of their time, times, log-likelihood) at `beta`."""
    scored = _weighted(design, beta, "eta").selectExpr("*", "w * exp(eta) AS r", "d * exp(eta) AS rd")
    by_time = scored.groupBy("time").agg(F.sum("r").alias("sr"), F.sum("rd").alias("e0"), F.sum("d").alias("m"), F.sum(F.expr("d * eta")).alias("z"))
    at_risk = running_totals(by_time, "time", {"sr": "s0"}, ranges=ranges, descending=True)
    times = running_totals(_tied_sums(at_risk, ties), "time", {"p0": "a"}, ranges=ranges)
    times = durable(times.select("time", "m", "a", "p1", "q0", "q1", "q2", "lg", "z"))
    loglik = times.agg(F.sum("z") - F.sum("lg")).first()[0] or 0.0
    rows = scored.join(_spread(times.select("time", "a", "p1"), ranges), "time")
    return durable(rows.select("model", "time", "cells", "d", "r", "rd", "a", "p1")), times, float(loglik)


def _product(rows: DataFrame, times: DataFrame, ranges: int, vector: np.ndarray) -> np.ndarray:
    """The information matrix times a vector."""
    along = _weighted(rows, vector, "y")
    by_time = along.groupBy("time").agg(F.sum(F.expr("r * y")).alias("ry"), F.sum(F.expr("rd * y")).alias("ey"))
    by_time = by_time.join(_spread(times.select("time", "m", "q0", "q1", "q2"), ranges), "time")
    risk = running_totals(by_time, "time", {"ry": "sy"}, ranges=ranges, descending=True)
    risk = risk.selectExpr("time", "if(m > 0, q0 * sy - q1 * ey, 0D) AS alpha", "if(m > 0, q2 * ey - q1 * sy, 0D) AS gamma")
    back = running_totals(risk, "time", {"alpha": "upto"}, ranges=ranges).select("time", "upto", "gamma")
    joined = along.join(_spread(back, ranges), "time")
    return _per_covariate(joined, len(vector), {"u": "v * (r * (a * y - upto) - rd * (p1 * y + gamma))"})[0]


def _solve(
    rows: DataFrame, times: DataFrame, ranges: int, diagonal: np.ndarray, right: np.ndarray, left: float = SOLVED
) -> np.ndarray:
    """Conjugate gradients on the information matrix, scaled by the diagonal, until a share `left` of the right side is left; covariates without information stay 0."""
    scale = np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 0)
    x, rest = np.zeros(len(right)), right.copy()
    z = scale * rest
    way, size = z.copy(), float(rest @ z)
    least = left * math.sqrt(float(right @ (scale * right)))
    for _ in range(min(PRODUCTS, 2 * len(right) + 10)):
        if size <= 0 or math.sqrt(size) <= least:
            break
        turned = _product(rows, times, ranges, way)
        along = float(way @ turned)
        if along <= 0:
            break
        x += size / along * way
        rest -= size / along * turned
        z = scale * rest
        size, before = float(rest @ z), size
        way = z + size / before * way
    return x


def coxph_wide(
    df: DataFrame,
    time: str,
    status: str,
    covariates: Sequence[Covariate],
    ties: str = "efron",
    weight: str | None = None,
    sorted_rows: int = SORTED_ROWS,
    max_steps: int = 20,
) -> WideFit:
    """Fit a model whose categories may have any number of levels; rows with a missing value are left out.

    The covariates must not be combinations of each other; one without information keeps coefficient 0. `converged` is false when the steps do not settle,
    as for a level without events. An empty table gives a fit without terms.
    """
    usable = df.dropna(subset=[time, status, *[c.col for c in covariates]])
    frame = model_frame(usable, time, status, [c.col for c in covariates], weight)
    numeric = [c.col for c in covariates if c.kind != "category"]
    died = F.when(F.col(status) == 1, F.col("w")).otherwise(0)
    facts = frame.agg(F.sum("w"), F.sum(died), *[F.sum(F.col("w") * F.col(c)) / F.sum("w") for c in numeric]).first()
    n, n_event, means = facts[0] or 0, facts[1] or 0, dict(zip(numeric, facts[2:], strict=True))
    size, terms, cells = 0, None, []
    for k, cov in enumerate(covariates):
        if cov.kind == "category":
            numbers = durable(number_levels(frame, cov.col, cov.baseline, cov.levels or (), sorted_rows))
            frame = encode_levels(frame, cov.col, numbers, f"_n{k}")
            cell: Column = F.struct((F.col(f"_n{k}") - 1 + size).alias("j"), F.lit(1.0).alias("v"))
            cells.append(F.when(F.col(f"_n{k}") > 0, cell))
            own = numbers.where("number > 0").select((F.col("number") - 1 + size).alias("j"), F.concat(F.lit(cov.col + "="), "level").alias("term"))
            size += max(numbers.count() - 1, 0)
        else:
            value = F.col(cov.col).cast("double") - F.lit(float(means[cov.col] or 0.0))
            cells.append(F.struct(F.lit(size).cast("long").alias("j"), value.alias("v")))
            own = df.sparkSession.createDataFrame([(size, cov.col)], "j long, term string")
            size += 1
        terms = own if terms is None else terms.unionByName(own)
    held = F.filter(F.array(*cells), lambda c: c.isNotNull())
    design = frame.select(F.lit(0).alias("model"), F.col(time).cast("double").alias("time"), held.alias("cells"), "w", died.alias("d"))
    design = durable(design.groupBy("model", "time", "cells").agg(F.sum("w").alias("w"), F.sum("d").alias("d")))
    ranges = count_ranges(design.select("time").distinct(), sorted_rows)

    beta, steps, converged = np.zeros(size), 0, size == 0 or not n
    rows, times, loglik = _state(design, beta, ranges, ties)
    loglik0, length = loglik, 1.0
    while not converged and steps < max_steps:
        score, diagonal = _per_covariate(rows, size, {"u": "v * (d - r * a + rd * p1)", "h": "v * v * (r * a - rd * p1)"})
        # Far from the end a rough step does; its error stays below the square of its length, as Newton's own.
        step = _solve(rows, times, ranges, diagonal, score, max(SOLVED, min(ROUGHLY, length * length)))
        length = float(np.abs(step).max())
        if length < STEP_TOL:
            beta, converged = beta + step, True
            break
        steps += 1
        for _ in range(10):
            found = _state(design, beta + step, ranges, ties)
            if found[2] >= loglik - 1e-10 * abs(loglik):
                break
            step = step / 2
        else:  # no step improves the likelihood: the last good estimate stays
            break
        beta, (rows, times, loglik) = beta + step, found
    return WideFit(terms, rows, times, ranges, beta, loglik0, loglik, n, n_event, steps, converged)


def wide_coefficients(fit: WideFit) -> DataFrame:
    """(term, coef, exp_coef) of every covariate."""
    found = fit.terms.sparkSession.createDataFrame([(j, float(b)) for j, b in enumerate(fit.coef)], "j long, coef double")
    return fit.terms.join(found, "j").select("term", "coef", F.exp("coef").alias("exp_coef"))


def wide_errors(fit: WideFit, terms: Sequence[str]) -> DataFrame:
    """(term, coef, se) of chosen covariates: one equation each, so that the inverse matrix is not needed."""
    diagonal = _per_covariate(fit.rows, len(fit.coef), {"h": "v * v * (r * a - rd * p1)"})[0]
    out = []
    for r in fit.terms.where(F.col("term").isin(*terms)).collect():
        unit = np.zeros(len(fit.coef))
        unit[r["j"]] = 1.0
        variance = float(_solve(fit.rows, fit.times, fit.ranges, diagonal, unit)[r["j"]])
        out.append((r["term"], float(fit.coef[r["j"]]), math.sqrt(variance) if variance > 0 else None))
    return fit.terms.sparkSession.createDataFrame(out, "term string, coef double, se double")
