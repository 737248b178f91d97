"""A learned decision list over statistics of texts, applied as one Spark conditional expression.

Sequential covering: a rule is grown on two thirds of the labelled rows, one threshold at a time by information gain, until it covers no good
document; then its last conditions are pruned as long as that doesn't hurt on the other third. A rule that isn't precise enough there is the end
of the list; otherwise what it covers is taken out and the next is grown. The rules come out as an ordered `when ... when ... otherwise`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import durable
from .statistics import COUNT_SCHEMA, COUNTS, FEATURES, append_counts, feature_columns

#: Labelled rows that the driver learns from, those with the least hash of their id.
SAMPLE_ROWS = 20_000
MOST_RULES = 12
MOST_CONDITIONS = 4
CUTS = 64
#: Share of bad documents among those a rule covers, held out and grown, and how many it must cover.
PRECISION = 0.95
LEAST_COVERED = 10
MIN_WORDS = 20
REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.cut if self.above else x[:, self.feature] <= self.cut

    def column(self) -> Column:
        value = F.col(f"f_{FEATURES[self.feature][0]}")
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> Rule:
    rule: list[Condition] = []
    on = np.ones(len(x), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad[on]).any():
        p, n = bad[on].sum(), (~bad[on]).sum()
        base, best = np.log2(p / (p + n)), None
        for f in range(x.shape[1]):
            place = np.searchsorted(cuts[f], x[on, f])  # number of cuts below the value
            bad_at = np.bincount(place[bad[on]], minlength=len(cuts[f]) + 1)
            good_at = np.bincount(place[~bad[on]], minlength=len(cuts[f]) + 1)
            low_p, low_n = np.cumsum(bad_at)[:-1], np.cumsum(good_at)[:-1]
            for above, ps, ns in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - base), 0)
                if len(gain) and (best is None or gain.max() > best[0]):
                    best = (gain.max(), Condition(f, above, float(cuts[f][gain.argmax()])))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on held-out rows."""

    def worth(r: Rule) -> float:
        on = _covered(r, x)
        return (bad[on].sum() - (~bad[on]).sum()) / max(1, on.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules for bad rows; rows in a fixed order give the same rules."""
    held = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < MOST_RULES:
        grow, prune = left & ~held, left & held
        if bad[grow].sum() < LEAST_COVERED:
            break
        cuts = [np.unique(np.concatenate((np.quantile(x[grow, f], np.linspace(0, 1, CUTS)), np.quantile(x[grow & bad, f], np.linspace(0, 1, CUTS))))) for f in range(x.shape[1])]
        rule = _grow(x[grow], bad[grow], cuts)
        if not rule:
            break
        rule = _prune(rule, x[prune], bad[prune])
        on = _covered(rule, x) & left
        if on.sum() < LEAST_COVERED or any(bad[on & side].sum() < PRECISION * (on & side).sum() for side in (held, ~held)):
            break
        rules.append(rule)
        left &= ~on
    return rules


def labelled(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness of the sample. A document with several labels counts by the lowest; missing labels and ids are left out."""
    sample = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label")).dropna()
    sample = sample.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    named = stats.withColumn("_id", F.col(id_col).cast("long")).select("_id", *feature_columns())
    # At most SAMPLE_ROWS rows of 16 bytes.
    rows = named.join(F.broadcast(sample), "_id").orderBy(F.xxhash64("_id"), "_id", *[f"f_{f}" for f, _, _ in FEATURES]).limit(SAMPLE_ROWS).drop("_id").toArrow()
    x = np.stack([rows.column(f"f_{f}").to_numpy() for f, _, _ in FEATURES], axis=1) if rows.num_rows else np.empty((0, len(FEATURES)))
    return x, rows.column("_label").to_numpy() == 0


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; NULL if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        on = rule[0].column()
        for c in rule[1:]:
            on = on & c.column()
        out = F.when(on, i) if out is None else out.when(on, i)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(append_counts(text_col), f"{schema}, {COUNT_SCHEMA}")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of `docs`: doc_id, the counts, base_failed, kept, rule (the number of the rule that rejects, else NULL).

    A missing text has no words and fails the base rules. Without labels the list is empty and the base rules decide alone. Repeated rows are judged alike, other
    columns are ignored.
    """
    stats = durable(_counted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text"))
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    rules = learn(*labelled(stats, named, "doc_id", "label"))
    featured = stats.select("doc_id", *COUNTS, *feature_columns(), base_failed().alias("base_failed"))
    ruled = featured.select("doc_id", *COUNTS, "base_failed", fired(rules).alias("rule"))
    return ruled.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that pass, with their columns. Texts are read twice and not shuffled."""
    stats = _counted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    rules = learn(*labelled(durable(stats), named, "doc_id", "label"))
    # Own names keep clear of columns that have the counts' names.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    judged = _counted(packed, "_text").select("_row", *COUNTS, *feature_columns())
    return judged.where(~base_failed() & fired(rules).isNull()).select("_row.*")
