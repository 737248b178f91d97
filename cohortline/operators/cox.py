"""Cox regression on distributed rows.

Rows are reduced once to one per (model, time, covariate pattern) with its number of rows and of
events; the driver only ever holds arrays of the size of the covariate lists.  Each Newton step is
one query for all models that still climb:

1. rows -> weight and weighted covariates per model and distinct time, totalled from the longest
   time down (the risk sets);
2. per event time, the sums over tied events that Efron's method needs, in closed form;
3. the information matrices.  Their covariate products are not totalled per risk set: a row is at
   risk at every event time up to its own, so its products enter once, with the running total
   of those times' weights.  What remains are products of the totals of step 1.

Coefficients enter as one constant map from model to array, so the code Spark compiles for the
first step serves all others.  Each model has its own step length and leaves the query once it has settled.

Up to WIDE covariates the products are summed per time in step 1, in one pass over the rows.
Beyond that a second pass sums them as cells of the non-zero covariates of each row, so zeros
of categories cost nothing. The plan still grows with the covariates of the widest model: it has a window
sum and a term of the linear predictor for each, and an entry for each pair of them. Categories with very many levels
belong to `wide_cox`.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .durable import durable
from .ordered import SORTED_ROWS, count_ranges, running_totals
from .survival import Z95

STEP_TOL = 1e-9
SINGULAR = 1e-9
DIRECT_TERMS = 32
WIDE = 6


@dataclass(frozen=True)
class Covariate:
    """A model term: `kind` is "numeric" or "category"; `baseline` a category's reference level.

    Without a baseline the reference is the first of `levels`, or of the sorted levels.
    """

    col: str
    kind: str = "numeric"
    baseline: str | None = None
    levels: tuple[str, ...] | None = None


@dataclass
class Stack:
    """Rows (model, time, w, d, x) of all models: w rows, d of them events, x = [1, covariates..., 0 up to `size`]."""

    rows: DataFrame
    size: int
    ranges: int


@dataclass
class Design:
    """A model's columns and its place among the stacked rows; numeric covariates are centred."""

    stack: Stack
    model: int
    columns: list[str]
    terms: dict[str, list[int]]
    n: int
    n_event: int
    event_totals: np.ndarray

    @property
    def size(self) -> int:
        return len(self.columns)

    @property
    def rows(self) -> DataFrame:
        return self.stack.rows.where(F.col("model") == self.model)


@dataclass
class CoxFit:
    """A fitted model: small arrays on the driver, the reduced rows on the cluster."""

    design: Design
    coef: np.ndarray
    var: np.ndarray
    kept: list[int]
    loglik0: float
    loglik: float
    score_test: float
    steps: int
    converged: bool
    ties: str

    @property
    def beta(self) -> np.ndarray:
        return np.where(np.isnan(self.coef), 0.0, self.coef)


def _ordered(cov: Covariate, found: Sequence[str]) -> list[str]:
    """The levels of a category that occur, reference first."""
    order = [v for v in cov.levels or () if v in found]
    order += sorted(v for v in found if v not in order)
    if cov.baseline in order:
        order.remove(cov.baseline)
        order.insert(0, cov.baseline)
    return order


def encode(df: DataFrame, col: str, baseline: str | None = None, levels=None) -> dict[str, Column]:
    """0/1 columns of a category against its baseline, by name; unused levels have none.

    Each level becomes a column of the caller's plan, so the levels are those of a plan. `wide_cox.number_levels` numbers
    them in a table instead, whatever how many.
    """
    level = F.col(col).cast("string")
    found = [r[0] for r in df.where(level.isNotNull()).select(level.alias("level")).distinct().collect()]
    return _dummies(col, _ordered(Covariate(col, "category", baseline, levels), found))


def _dummies(col: str, used: Sequence[str]) -> dict[str, Column]:
    return {
        f"{col}={v}": F.when(F.col(col).cast("string") == v, 1.0).otherwise(0.0) for v in used[1:]
    }


def model_frame(
    df: DataFrame, time: str, status: str, cols: Sequence[str], weight: str | None = None
) -> DataFrame:
    """A durable table of the distinct (time, status, cols) with their number of rows `w`.

    It serves any model of these columns with `weight="w"`.
    """
    counted = F.sum(weight) if weight else F.count(F.lit(1))
    usable = df.dropna(subset=[time, status])
    return durable(usable.groupBy(time, status, *dict.fromkeys(cols)).agg(counted.alias("w")))


def designs(
    df: DataFrame,
    time: str,
    status: str,
    models: Mapping[str, Sequence[Covariate]],
    weight: str | None = None,
    sorted_rows: int = SORTED_ROWS,
) -> dict[str, Design]:
    """The rows of several models in one table; a model leaves out those that miss one of its values."""
    frame = model_frame(df, time, status, [c.col for covariates in models.values() for c in covariates], weight)
    died = F.when(F.col(status) == 1, F.col("w")).otherwise(0)
    none = F.lit(None).cast("string"), F.lit(None).cast("double")

    def whole(covariates: Sequence[Covariate], made: Column) -> Column:
        return F.when(F.coalesce(*[F.when(F.col(c.col).isNull(), False) for c in covariates], F.lit(True)), made)

    # One aggregate for the sizes of all models, the means of their numbers and the events of their levels.
    cells = []
    for m, covariates in enumerate(models.values()):
        for k, cov in enumerate([None, *covariates]):
            if cov is None:
                level, value = none
            elif cov.kind == "category":
                level, value = F.col(cov.col).cast("string"), none[1]
            else:
                level, value = none[0], F.col(cov.col).cast("double")
            cell = F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), level.alias("level"), value.alias("value"))
            cells.append(whole(covariates, cell))
    facts = frame.select("w", died.alias("d"), F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL")
    facts = facts.groupBy("cell.m", "cell.k", "cell.level").agg(
        F.sum("w").alias("w"), F.sum("d").alias("d"),
        F.sum(F.col("w") * F.col("cell.value")).alias("wv"), F.sum(F.col("d") * F.col("cell.value")).alias("dv"),
    )
    known = {(r["m"], r["k"], r["level"]): r for r in facts.collect()}

    made: list[tuple] = []
    for m, covariates in enumerate(models.values()):
        columns, terms, values, event_totals = [], {}, [F.lit(1.0)], []
        size = known.get((m, 0, None))
        n, n_event = (size["w"], size["d"]) if size else (0, 0)
        for k, cov in enumerate(covariates, 1):
            if cov.kind == "category":
                used = _ordered(cov, [level for a, b, level in known if (a, b) == (m, k)])
                added = _dummies(cov.col, used)
                event_totals += [known[m, k, v]["d"] for v in used[1:]]
            else:
                fact = known.get((m, k, None))
                mean = float(fact["wv"]) / fact["w"] if fact else 0.0
                added = {cov.col: F.col(cov.col).cast("double") - F.lit(mean)}
                event_totals.append(float(fact["dv"]) - n_event * mean if fact else 0.0)
            terms[cov.col] = list(range(len(columns), len(columns) + len(added)))
            columns += added
            values += added.values()
        made.append((columns, terms, n, n_event, np.array(event_totals, dtype=float), values))

    size = max(len(columns) for columns, *_ in made)
    arms = []
    for m, (covariates, (columns, *_, values)) in enumerate(zip(models.values(), made, strict=True)):
        x = F.array(*values, *[F.lit(0.0)] * (size - len(columns)))
        arms.append(whole(covariates, F.struct(F.lit(m).alias("model"), x.alias("x"))))
    rows = frame.select(F.col(time).cast("double").alias("time"), "w", died.alias("d"), F.explode(F.array(*arms)).alias("arm"))
    rows = rows.where("arm IS NOT NULL").groupBy("arm.model", "time", "arm.x").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    rows = durable(rows)
    stack = Stack(rows, size, count_ranges(rows.select("time").distinct(), sorted_rows))
    return {name: Design(stack, m, *made[m][:5]) for m, name in enumerate(models)}


def _betas(betas: Mapping[int, Sequence[float]], size: int) -> str:
    """A constant map from model to its `size` coefficients; models without have none."""
    arms = []
    for model, beta in betas.items():
        padded = [*beta, *[0.0] * (size - len(beta))]
        arms.append(f"{int(model)}, CAST(array({', '.join(f'{float(b)!r}D' for b in padded)}) AS array<double>)")
    return f"map({', '.join(arms)})"


def _predictor(size: int) -> str:
    return " + ".join(f"beta[{i}] * x[{i + 1}]" for i in range(size)) or "0.0D"


def _scored(stack: Stack, betas: Mapping[int, Sequence[float]]) -> DataFrame:
    """The rows of the models in `betas` with their linear predictor `eta`."""
    rows = stack.rows.selectExpr("*", f"try_element_at({_betas(betas, stack.size)}, model) AS beta").where("beta IS NOT NULL")
    return rows.selectExpr("model", "time", "w", "d", "x", f"{_predictor(stack.size)} AS eta")


def _tied_sums(times: DataFrame, ties: str) -> DataFrame:
    """Add the sums over the m tied events of a time that weight its moments; 0 without events.

    With risk-set weight s0, weight e0 of the events and shares l/m, l = 0..m-1, D = s0 - e0*l/m:
    p0 = sum 1/D, p1 = sum (l/m)/D, q0, q1, q2 = sum (l/m)^k/D^2 and lg = sum ln D.  All follow
    from sums h1, h2, g of 1/x, 1/x^2 and ln x over x = c, c-1, .., c-m+1 with c = s0*m/e0.  The
    last DIRECT_TERMS terms are added one by one, the ones before by the Euler-Maclaurin formula,
    which is exact to double precision there: no time, however many ties it has, is expanded.
    """
    if ties == "breslow":
        sums = ["m / s0 AS p0", "0D AS p1", "m / (s0 * s0) AS q0", "0D AS q1", "0D AS q2", "m * ln(s0) AS lg"]
        return times.selectExpr("*", *sums)
    # Rounding may leave the last x a hair under 1; it is never less.
    direct = """if(m > 0, aggregate(
        sequence(skipped, greatest(m - 1, skipped)),
        named_struct('h1', 0D, 'h2', 0D, 'lx', 0D),
        (acc, l) -> named_struct(
            'h1', acc.h1 + 1 / greatest(c - l, 1D),
            'h2', acc.h2 + 1 / (greatest(c - l, 1D) * greatest(c - l, 1D)),
            'lx', acc.lx + ln(greatest(c - l, 1D)))), NULL) AS direct"""
    skipped = {
        "h1": "-log1p(-skipped / c) - (1/low - 1/c) / 2 + (1/pow(low, 2) - 1/pow(c, 2)) / 12"
        " - (1/pow(low, 4) - 1/pow(c, 4)) / 120 + (1/pow(low, 6) - 1/pow(c, 6)) / 252",
        "h2": "skipped / (c * low) - (1/pow(low, 2) - 1/pow(c, 2)) / 2"
        " + (1/pow(low, 3) - 1/pow(c, 3)) / 6 - (1/pow(low, 5) - 1/pow(c, 5)) / 30"
        " + (1/pow(low, 7) - 1/pow(c, 7)) / 42",
        "lx": "skipped * ln(c) - low * log1p(-skipped / c) - skipped - log1p(-skipped / c) / 2"
        " - (1/low - 1/c) / 12 + (1/pow(low, 3) - 1/pow(c, 3)) / 360 - (1/pow(low, 5) - 1/pow(c, 5)) / 1260",
    }
    sums = {
        "p0": "h1 / b",
        "p1": "(c * h1 - m) / (b * m)",
        "q0": "h2 / (b * b)",
        "q1": "(c * h2 - h1) / (b * b * m)",
        "q2": "(c * c * h2 - 2 * c * h1 + m) / (b * b * m * m)",
        "lg": "m * ln(b) + lx",
    }
    return (
        times.selectExpr(
            "*",
            "if(m > 0, e0 / m, 1D) AS b",
            "if(m > 0, s0 * m / e0, 1D) AS c",
            f"greatest(m - {DIRECT_TERMS}, 0L) AS skipped",
        )
        .selectExpr("*", "c - skipped AS low", direct)
        .selectExpr("*", *[f"direct.{h} + if(skipped > 0, {v}, 0D) AS {h}" for h, v in skipped.items()])
        .selectExpr("*", *[f"if(m > 0, {v}, 0D) AS {n}" for n, v in sums.items()])
        .drop("b", "c", "skipped", "low", "direct", "h1", "h2", "lx")
    )


def _upper(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _risk_sets(
    stack: Stack, betas: Mapping[int, Sequence[float]], ties: str, clock: bool = False, cross: bool = False
) -> DataFrame:
    """One row per model and distinct time: events m, risk-set totals s, event totals e, tied sums.

    With `clock`, also g = 1 - S(t-) of the Kaplan-Meier curve of the model's rows.  With `cross`, the
    time's own covariate products ac (all rows), dc (events) and event totals z.
    """
    size = stack.size + 1
    scored = _scored(stack, betas).selectExpr("*", "w * exp(eta) AS r", "d * exp(eta) AS rd")
    sums = {"n": "w", "m": "d"}
    for i, j in _upper(size) if cross else [(0, j) for j in range(size)]:
        product = "".join(f" * x[{k}]" for k in (i, j) if k)
        sums |= {f"c{i}_{j}": f"r{product}", f"d{i}_{j}": f"rd{product}"}
    if cross:
        sums |= {f"z{j}": f"d * x[{j}]" for j in range(size)}
    by_time = scored.groupBy("model", "time").agg(*[F.expr(f"sum({v}) AS {n}") for n, v in sums.items()])
    totals = {f"c0_{j}": f"s{j}" for j in range(size)}
    if clock:
        totals["n"] = "n_risk"
    at_risk = running_totals(by_time, "time", totals, ["model"], stack.ranges, descending=True)
    if clock:
        at_risk = at_risk.selectExpr("*", "if(m < n_risk, log1p(-m / n_risk), 0D) AS fall")
        at_risk = running_totals(at_risk, "time", {"fall": "fallen"}, ["model"], stack.ranges)
        at_risk = at_risk.selectExpr("*", "1 - exp(fallen - fall) AS g")
    else:
        at_risk = at_risk.selectExpr("*", "1D AS g")
    packed = {"s": [f"s{j}" for j in range(size)], "e": [f"d0_{j}" for j in range(size)]}
    if cross:
        packed["ac"] = [*[f"c{i}_{j}" for i, j in _upper(size)], "0D"]
        packed["dc"] = [*[f"d{i}_{j}" for i, j in _upper(size)], "0D"]
        packed["z"] = [f"z{j}" for j in range(size)]
    arrays = [f"array({', '.join(names)}) AS {out}" for out, names in packed.items()]
    return _tied_sums(at_risk.selectExpr("model", "time", "m", "g", "s0", "d0_0 AS e0", *arrays), ties)


def _cells(stack: Stack, betas, ties: str, powers: Sequence[int], clock: bool) -> DataFrame:
    """Rows (model, i, j, y per power, z per power) that add up to the information matrices and scores.

    Pair (0, j) holds what the score of covariate j needs; i = -1 the log term.
    """
    size, cross = stack.size + 1, stack.size <= WIDE
    times = _risk_sets(stack, betas, ties, clock, cross)
    times = times.selectExpr("*", *[f"p0 * pow(g, {k}) AS h{k}" for k in powers])
    times = running_totals(times, "time", {f"h{k}": f"a{k}" for k in powers}, ["model"], stack.ranges)
    product = "q0 * s[i] * s[j] - q1 * (s[i] * e[j] + e[i] * s[j]) + q2 * e[i] * e[j]"
    product = f"if(i > 0 AND m > 0, {product}, 0D)"
    places = f"array({', '.join(f'struct({i} AS i, {j} AS j)' for i, j in [*_upper(size), (-1, 0)])})"
    if cross:
        pairs = times.selectExpr("*", f"posexplode({places}) AS (at, place)").selectExpr(
            "*", "place.i AS i", "place.j AS j"
        )
        return pairs.selectExpr(
            "model",
            "i",
            "j",
            *[f"if(i < 0, lg, ac[at] * a{k} - (dc[at] * p1 + {product}) * pow(g, {k})) AS y{k}" for k in powers],
            *[f"if(i = 0, z[j], 0D) * pow(g, {k}) AS z{k}" for k in powers],
        )

    # Many covariates: products of the non-zero ones, row by row, instead of all per time.
    spread = times.select("model", "time", "g", "p1", *[f"a{k}" for k in powers])
    if stack.ranges == 1:  # so at most SORTED_ROWS distinct times a model
        spread = F.broadcast(spread)
    present = "filter(transform(x, (v, n) -> struct(n, v)), q -> q.v <> 0)"
    products = """flatten(transform(present, a -> transform(
        filter(present, b -> b.n >= a.n), b -> struct(a.n AS i, b.n AS j, a.v * b.v AS v))))"""
    rows = (
        _scored(stack, betas)
        .selectExpr("model", "time", "d", f"{present} AS present", "w * exp(eta) AS r", "d * exp(eta) AS rd")
        .join(spread, ["model", "time"])
        .selectExpr(
            "model",
            f"inline({products})",
            *[f"r * a{k} - rd * p1 * pow(g, {k}) AS y{k}" for k in powers],
            *[f"d * pow(g, {k}) AS z{k}" for k in powers],
        )
        .selectExpr("model", "i", "j", *[f"{c}{k} * v AS {c}{k}" for c in "yz" for k in powers])
    )
    means = (
        times.filter("m > 0")
        .selectExpr("*", f"inline({places})")
        .filter("i <> 0")
        .selectExpr(
            "model",
            "i",
            "j",
            *[f"if(i < 0, lg, -{product} * pow(g, {k})) AS y{k}" for k in powers],
            *[f"0D AS z{k}" for k in powers],
        )
    )
    return rows.unionByName(means)


def _information(stack: Stack, betas, ties: str, powers: Sequence[int] = (0,), clock: bool = False) -> dict[int, tuple]:
    """Log term, scores and information matrices of each model, each time weighted by g to the given powers.

    A value is (lg, [score vector per power], [matrix per power]).
    """
    size = stack.size
    out = {m: [0.0, [np.zeros(size) for _ in powers], [np.zeros((size, size)) for _ in powers]] for m in betas}
    cells = _cells(stack, betas, ties, powers, clock)
    sums = [F.expr(f"sum({c}{k}) AS {c}{k}") for c in "yz" for k in powers]
    for row in cells.groupBy("model", "i", "j").agg(*sums).collect():
        i, j, found = row["i"], row["j"], out[row["model"]]
        for k, power in enumerate(powers):
            if i < 0:
                found[0] = row["y0"]
            elif i == 0 and j > 0:
                found[1][k][j - 1] = row[f"z{power}"] - row[f"y{power}"]
            elif i > 0:
                found[2][k][i - 1, j - 1] = found[2][k][j - 1, i - 1] = row[f"y{power}"]
    return {m: tuple(v) for m, v in out.items()}


def _evaluate_all(designs: Sequence[Design], betas: Sequence[np.ndarray], ties: str) -> list[tuple]:
    """Log-likelihood, score vector and information matrix of each model at its `beta`."""
    found = _information(designs[0].stack, {d.model: b for d, b in zip(designs, betas, strict=True)}, ties)
    out = []
    for d, beta in zip(designs, betas, strict=True):
        log_term, (score,), (info,) = found[d.model]
        out.append((float(beta @ d.event_totals) - log_term, score[: d.size], info[: d.size, : d.size]))
    return out


def _evaluate(d: Design, beta: np.ndarray, ties: str) -> tuple[float, np.ndarray, np.ndarray]:
    return _evaluate_all([d], [beta], ties)[0]


def _independent(info: np.ndarray) -> list[int]:
    """Columns that are no combination of earlier ones, judged by their remaining variance."""
    kept: list[int] = []
    for j in range(len(info)):
        left = info[j, j]
        if kept:
            cross = info[np.ix_(kept, [j])][:, 0]
            left -= cross @ np.linalg.solve(info[np.ix_(kept, kept)], cross)
        if info[j, j] > 0 and left > SINGULAR * info[j, j]:
            kept.append(j)
    return kept


@dataclass
class _Climb:
    """Newton's method for one model: where it stands, and the trial it waits for."""

    d: Design
    ties: str
    max_steps: int
    at: tuple[float, np.ndarray, np.ndarray] = field(init=False)
    trial: np.ndarray | None = field(init=False)
    steps: int = 0
    halved: int = 0
    converged: bool = False

    def begin(self, at_zero: tuple[float, np.ndarray, np.ndarray]) -> None:
        self.beta, self.at, self.loglik0 = np.zeros(self.d.size), at_zero, at_zero[0]
        self.kept = _independent(at_zero[2])
        self.grid = np.ix_(self.kept, self.kept)
        score = at_zero[1][self.kept]
        self.score_test = float(score @ np.linalg.solve(at_zero[2][self.grid], score)) if self.kept else 0.0
        self.converged = not self.kept
        self._propose()

    def _propose(self) -> None:
        self.trial = None
        if self.converged or self.steps >= self.max_steps:
            return
        try:
            self.step = np.linalg.solve(self.at[2][self.grid], self.at[1][self.kept])
        except np.linalg.LinAlgError:
            return
        if np.max(np.abs(self.step)) < STEP_TOL:
            self.beta[self.kept] += self.step
            self.converged = True
            return
        self.steps, self.halved = self.steps + 1, 0
        self._set_trial()

    def _set_trial(self) -> None:
        self.trial = self.beta.copy()
        self.trial[self.kept] += self.step

    def take(self, new: tuple[float, np.ndarray, np.ndarray]) -> None:
        """Go to the trial if it is no worse, else try half the step; after ten halves the last good estimate stays."""
        # Rounding moves the likelihood in its last digits once the steps are tiny.
        if new[0] >= self.at[0] - 1e-10 * abs(self.at[0]):
            self.beta, self.at = self.trial, new
            self._propose()
            return
        self.step, self.halved = self.step / 2, self.halved + 1
        if self.halved < 10:
            self._set_trial()
        else:
            self.trial = None

    def fit(self) -> CoxFit:
        size = self.d.size
        coef, var = np.full(size, np.nan), np.full((size, size), np.nan)
        coef[self.kept] = self.beta[self.kept]
        if self.kept:
            try:
                var[self.grid] = np.linalg.inv(self.at[2][self.grid])
            except np.linalg.LinAlgError:
                self.converged = False
        return CoxFit(
            self.d, coef, var, self.kept, self.loglik0, self.at[0], self.score_test, self.steps, self.converged, self.ties
        )


def coxph_all(
    df: DataFrame,
    time: str,
    status: str,
    models: Mapping[str, Sequence[Covariate]],
    ties: str = "efron",
    weight: str | None = None,
    sorted_rows: int = SORTED_ROWS,
    max_steps: int = 20,
) -> dict[str, CoxFit]:
    """Fit several proportional-hazards models at once; each leaves out rows with a missing value of its own.

    Every step is one evaluation of all models that have not settled yet. `weight` is a column of row counts.  A covariate column
    without variation or a combination of earlier ones gets no coefficient (NaN here, NULL in tables).  `converged` is false when
    the steps do not settle within `max_steps` Newton steps, as for a level without events; a
    step that cannot improve the likelihood leaves the last estimate.
    """
    made = designs(df, time, status, models, weight, sorted_rows)
    climbs = [_Climb(d, ties, max_steps) for d in made.values()]
    zero = _evaluate_all([c.d for c in climbs], [np.zeros(c.d.size) for c in climbs], ties) if climbs else []
    for climb, found in zip(climbs, zero, strict=True):
        climb.begin(found)
    while going := [c for c in climbs if c.trial is not None]:
        for climb, found in zip(going, _evaluate_all([c.d for c in going], [c.trial for c in going], ties), strict=True):
            climb.take(found)
    return {name: climb.fit() for name, climb in zip(made, climbs, strict=True)}


def coxph(
    df: DataFrame,
    time: str,
    status: str,
    covariates: Sequence[Covariate],
    ties: str = "efron",
    weight: str | None = None,
    sorted_rows: int = SORTED_ROWS,
    max_steps: int = 20,
) -> CoxFit:
    """Fit one proportional-hazards model; see `coxph_all`."""
    return coxph_all(df, time, status, {"": covariates}, ties, weight, sorted_rows, max_steps)[""]


def cox_loglik_at(
    df: DataFrame,
    time: str,
    status: str,
    covariates: Sequence[Covariate],
    beta: Sequence[float],
    ties: str = "efron",
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """(loglik, score_<column>...) of the partial likelihood at a given `beta`."""
    d = designs(df, time, status, {"": covariates}, sorted_rows=sorted_rows)[""]
    loglik, score, _ = _evaluate(d, np.array(beta, dtype=float), ties)
    schema = ", ".join(["loglik double", *[f"`score_{c}` double" for c in d.columns]])
    return df.sparkSession.createDataFrame([(loglik, *map(float, score))], schema)


def cox_score_at_zero(
    df: DataFrame, time: str, status: str, covariate: Covariate, ties: str = "efron", sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """(score, information, chisq) of one column at coefficient 0: without ties the log-rank test."""
    d = designs(df, time, status, {"": [covariate]}, sorted_rows=sorted_rows)[""]
    if d.size != 1:
        raise ValueError("the covariate must give one column")
    _, score, info = _evaluate(d, np.zeros(1), ties)
    u, v = float(score[0]), float(info[0, 0])
    return df.sparkSession.createDataFrame([(u, v, u * u / v)], "score double, information double, chisq double")


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the half-integer recurrence."""
    if df <= 0 or x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        tail, a = math.erfc(math.sqrt(half)), 0.5
    else:
        tail, a = math.exp(-half), 1.0
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(1.0, tail)


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _or_none(v) -> float | None:
    v = float(v)
    return v if math.isfinite(v) else None


def cox_summary(fit: CoxFit) -> DataFrame:
    """One row per coefficient: estimate, hazard ratio, error, z, p and 95 % limits."""
    rows = []
    with np.errstate(over="ignore"):  # an infinite limit is shown as NULL
        for i, name in enumerate(fit.design.columns):
            b = fit.coef[i]
            se = math.sqrt(fit.var[i, i]) if fit.var[i, i] >= 0 else math.nan
            z = b / se if se else math.nan
            shown = (b, np.exp(b), se, z, _normal_p(z), np.exp(b - Z95 * se), np.exp(b + Z95 * se))
            rows.append((name, *map(_or_none, shown)))
    schema = "term string, coef double, exp_coef double, se double, z double, p double, lower double, upper double"
    return fit.design.rows.sparkSession.createDataFrame(rows, schema)


def cox_tests(fit: CoxFit, with_concordance: bool = True) -> DataFrame:
    """One row per model: sizes, log-likelihoods, the three global tests and the concordance."""
    df = len(fit.kept)
    b = fit.coef[fit.kept]
    v = fit.var[np.ix_(fit.kept, fit.kept)]
    wald = float(b @ np.linalg.solve(v, b)) if df and np.isfinite(v).all() else math.nan
    lrt = 2 * (fit.loglik - fit.loglik0)
    c = concordance(fit) if with_concordance else None
    schema = (
        "n long, n_event long, df int, loglik0 double, loglik double, lrt double, lrt_p double, "
        "wald double, wald_p double, score double, score_p double, concordance double, "
        "steps int, converged boolean"
    )
    row = (
        fit.design.n, fit.design.n_event, df, fit.loglik0, fit.loglik, lrt, chi2_tail(lrt, df), _or_none(wald),
        _or_none(chi2_tail(wald, df)), fit.score_test, chi2_tail(fit.score_test, df), c, fit.steps, fit.converged,
    )
    return fit.design.rows.sparkSession.createDataFrame([row], schema)


def cox_tests_all(fits: Mapping[str, CoxFit], with_concordance: bool = True) -> DataFrame:
    """The tests of several models, one row each, with a `model` column."""
    out = None
    for name, fit in fits.items():
        part = cox_tests(fit, with_concordance).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def cox_table(fits: Mapping[str, CoxFit]) -> DataFrame:
    """The coefficients of several models, one after the other, with a `model` column."""
    out = None
    for name, fit in fits.items():
        part = cox_summary(fit).select(
            F.lit(name).alias("model"), "*", F.lit(fit.design.n).cast("long").alias("n"),
            F.lit(fit.design.n_event).cast("long").alias("n_event"), F.lit(fit.converged).alias("converged"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _pair_counts(times: np.ndarray, scores: np.ndarray, d: np.ndarray, k: np.ndarray, within: bool = True) -> np.ndarray:
    """[concordant, discordant, tied] pairs of an event and a comparable row, among points with d events and k others.

    Comparable with an event are all points of a later time and, if `within`, the others of the same time. Scores are taken as ranks. Two
    different ranks agree in their leading bits up to one place; for each place the points are sorted by the bits above it and time, and
    running totals count the later points with the other bit.
    """
    _, ranks = np.unique(scores, return_inverse=True)
    places = max(int(ranks.max()).bit_length(), 1) if len(ranks) else 0
    found = np.zeros(3)
    for place in range(-1, places):
        above = ranks if place < 0 else ranks >> (place + 1)
        order = np.lexsort((-times, above))
        group, when = above[order], times[order]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new_time = new_group | np.concatenate(([True], when[1:] != when[:-1]))
        first = np.maximum.accumulate(np.where(new_group, np.arange(len(order)), 0))
        start = np.maximum.accumulate(np.where(new_time, np.arange(len(order)), 0))
        edges = np.concatenate((np.flatnonzero(new_time), [len(order)]))
        end = np.repeat(edges[1:], np.diff(edges))
        bit = np.zeros(len(order), dtype=np.int64) if place < 0 else ranks[order] >> place & 1
        for side in (0, 1) if place >= 0 else (0,):
            here = bit == side
            total = np.concatenate(([0], np.cumsum(np.where(here, d[order] + k[order], 0))))
            others = np.concatenate(([0], np.cumsum(np.where(here, k[order], 0))))
            after = total[start] - total[first] + (others[end] - others[start] if within else 0)
            events = d[order] * (here if place < 0 else ~here)
            found[2 if place < 0 else side] += (events.astype(float) * after).sum()
    return found


def _pair_sums(points: DataFrame, by: str | None, time: str, score: str, ties: bool, within: bool = True) -> np.ndarray:
    """The pair counts within each group of `by`, added up; Spark groups, a task counts one group at a time."""

    def count(table):
        import pyarrow as pa

        columns = [table.column(c).to_numpy() for c in (time, score, "d", "k")]
        found = _pair_counts(*columns, within=within)
        return pa.table({"good": found[:1], "bad": found[1:2], "tied": found[2:]})

    schema = "good double, bad double, tied double"
    groups = points.select(time, score, "d", "k", F.col(by).alias("_by") if by else F.lit(0).alias("_by")).groupBy("_by")
    row = groups.applyInArrow(count, schema).agg(F.sum("good"), F.sum("bad"), F.sum("tied")).first()
    found = np.array([float(v or 0.0) for v in row])
    return found if ties else found * [1, 1, 0]


def concordance(fit: CoxFit, sorted_rows: int = SORTED_ROWS) -> float | None:
    """Share of comparable pairs in which the higher risk score has the earlier event.

    Exact, without forming pairs, on one point for each distinct (time, score). Up to `sorted_rows` points are counted in one task. Beyond, scores are
    cut into ranges of about that many points, and times likewise. Pairs within a range of scores are counted there; pairs of different
    score ranges by the numbers of points for each (time, score range) within a range of times; pairs that differ in both ranges by the
    numbers for each pair of ranges. So a point is shuffled twice, however many there are. Points of one score stay in one range.
    """
    scored = _scored(fit.design.stack, {fit.design.model: fit.beta}).selectExpr("time", "round(eta, 12) AS score", "d", "w - d AS k")
    counts = [F.sum("d").alias("d"), F.sum("k").alias("k")]
    points = durable(scored.groupBy("time", "score").agg(*counts))
    ranges = count_ranges(points, sorted_rows)
    if ranges == 1:
        found = _pair_sums(points, None, "time", "score", ties=True)
    else:
        points = durable(points.repartitionByRange(ranges, "score").withColumn("score_range", F.spark_partition_id()))
        found = _pair_sums(points, "score_range", "time", "score", ties=True)
        by_range = points.groupBy("time", "score_range").agg(*counts)
        by_range = durable(by_range.repartitionByRange(ranges, "time").withColumn("time_range", F.spark_partition_id()))
        found = found + _pair_sums(by_range, "time_range", "time", "score_range", ties=False)
        grid = by_range.groupBy("time_range", "score_range").agg(*counts)
        found = found + _pair_sums(grid, None, "time_range", "score_range", ties=False, within=False)
    concordant, discordant, tied = found
    pairs = concordant + discordant + tied
    return float((concordant + tied / 2) / pairs) if pairs else None


def cox_zph(fit: CoxFit) -> DataFrame:
    """(term, chisq, df, p): score test of a coefficient drifting with 1 - S(t-), per term and global."""
    d = fit.design
    found = _information(d.stack, {d.model: fit.beta}, fit.ties, (0, 1, 2), clock=True)
    _, (_, u1, _), (i0, i1, i2) = found[d.model]

    def test(name: str, drift: list[int]):
        drift = [j for j in drift if j in fit.kept]
        if not drift:
            return (name, None, 0, None)
        base = i0[np.ix_(fit.kept, fit.kept)]
        cross = i1[np.ix_(fit.kept, drift)]
        left = i2[np.ix_(drift, drift)] - cross.T @ np.linalg.solve(base, cross)
        chisq = float(u1[drift] @ np.linalg.solve(left, u1[drift]))
        return (name, chisq, len(drift), chi2_tail(chisq, len(drift)))

    rows = [test(name, cols) for name, cols in d.terms.items()]
    rows.append(test("GLOBAL", list(range(d.size))))
    return d.rows.sparkSession.createDataFrame(rows, "term string, chisq double, df int, p double")


def schoenfeld_residuals(fit: CoxFit) -> DataFrame:
    """(time, term, residual, scaled, n): what each event's covariates differ from their risk set.

    `scaled` is the residual vector times the covariance matrix and the number of events, plus
    the coefficient: its trend over time is the coefficient's.  `n` equal events share a row.
    """
    d = fit.design
    means = _risk_sets(d.stack, {d.model: fit.beta}, fit.ties).filter("m > 0")
    means = means.selectExpr("time", "transform(s, (v, i) -> (v * p0 - e[i] * p1) / m) AS mean")
    events = d.rows.filter("d > 0").join(means, "time")
    events = events.selectExpr("time", "d AS n", "transform(x, (v, i) -> v - mean[i]) AS r")

    def scaled(i: int) -> str:
        parts = [f"({float(fit.var[i, j] * d.n_event)!r}D) * r[{j + 1}]" for j in fit.kept]
        return " + ".join([f"({float(fit.coef[i])!r}D)", *parts])

    cells = [
        F.struct(
            F.lit(d.columns[i]).alias("term"),
            F.col("r")[i + 1].alias("residual"),
            F.expr(scaled(i)).alias("scaled"),
        )
        for i in fit.kept
    ]
    return events.select("time", F.inline(F.array(*cells)), "n")
