"""Hierarchical empirical Bayes: a document classifier's evidence with the records of its host and path.

1. The classifier: a logistic regression over binned statistics of the text and one score of telltale words, fitted on a bounded sample of
   labelled documents. Telltale words occur far more often in bad documents (log-likelihood ratio test over the sample's words).
2. Every document gets its probability of being bad under the overall rate. Sums of these by host, and by path within the host, are plain
   grouped aggregates.
3. A host's rate is shrunk towards the overall rate, a path's towards its host's. How strongly is estimated from how much the groups
   differ (method of moments), so sparse sites follow the prior and large ones their own record.
4. A document's own evidence then replaces the overall prior odds by its path's, in which it doesn't count itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import durable
from .ngram_join import _Frequent
from .statistics import counts, feature_matrix
from .words import Words, chunks, encoded, slices

#: Labelled documents to fit on, those with the least hash of their id, and telltale words at most.
SAMPLE_ROWS = 20_000
MOST_WORDS = 2_000
LEAST_DOCS = 8
LEAST_RATIO_TEST = 30.0
BINS = 10
RIDGE = 1.0
#: Bounds of the pseudo-counts of a prior.
STRENGTH = (1.0, 10_000.0)


def _word_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Distinct hashes of each text's letter runs, ASCII in lower case."""
    for _, part in chunks(texts):
        words = Words(part, lower=True, letters=True)
        hashes = words.hashes()
        for i in range(len(part)):
            yield np.unique(hashes[words.first[i] : words.first[i + 1]])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bad = batch.column("bad").to_numpy(zero_copy_only=False).astype(bool)
        sets = list(_word_sets(encoded(batch.column("text").to_pylist())))
        if not sets:
            continue
        every = np.concatenate(sets)
        of_bad = np.repeat(bad, [len(x) for x in sets])
        word, back = np.unique(every, return_inverse=True)
        n_bad = np.bincount(back[of_bad], minlength=len(word))
        n_all = np.bincount(back, minlength=len(word))
        yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n_bad.astype(np.int64)), pa.array(n_all.astype(np.int64))], names=["word", "n_bad", "n_all"])


class _Scores:
    """The score of telltale words: the sum of the weights of those that a text has."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        order = np.argsort(words)
        self.words, self.weights = words[order], weights[order]
        self.among = _Frequent(words)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        if len(self.words):
            for i, own in enumerate(_word_sets(texts)):
                hit = own[self.among(own)]
                out[i] = self.weights[np.searchsorted(self.words, hit)].sum()
        return out


def _inputs(words: np.ndarray, weights: np.ndarray):
    def inputs(texts: list[bytes]) -> np.ndarray:
        return np.concatenate((feature_matrix(counts(texts)), _Scores(words, weights)(texts)[:, None]), axis=1)

    return inputs


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One column for each bin of each feature, and one of ones."""
    parts = [np.ones((len(x), 1))]
    for f, c in enumerate(cuts):
        parts.append((np.searchsorted(c, x[:, f], side="right")[:, None] == np.arange(len(c) + 1)).astype(float))
    return np.concatenate(parts, axis=1)


def fit(x: np.ndarray, bad: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cuts of each feature and the coefficients over their bins: ridge logistic regression by Newton's method."""
    cuts = []
    for f in range(x.shape[1]):
        spread = [np.quantile(x[side, f], np.linspace(0, 1, BINS + 1)[1:-1]) for side in (bad, ~bad) if side.any()]
        cuts.append(np.unique(np.concatenate(spread)) if spread else np.empty(0))
    z = _binned(x, cuts)
    beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (bad - p) - penalty * beta
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), gradient)
        beta = beta + step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return cuts, beta


def telltale(counted: DataFrame, n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights (log odds) of the words that mark bad documents."""
    if not n_bad or not n_good:
        return np.empty(0, np.uint64), np.empty(0)
    words = counted.groupBy("word").agg(F.sum("n_bad").alias("b"), F.sum("n_all").alias("n")).where(F.col("n") >= LEAST_DOCS)
    share = n_bad / (n_bad + n_good)
    g, b = F.col("n") - F.col("b"), F.col("b").cast("double")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    test = 2 * (part(b, F.col("n") * share) + part(g.cast("double"), F.col("n") * (1 - share)))
    found = words.withColumn("test", test).where((F.col("test") >= LEAST_RATIO_TEST) & (b > F.col("n") * share))
    top = found.orderBy(F.desc("test"), "word").limit(MOST_WORDS).toArrow()
    b, n = top.column("b").to_numpy().astype(float), top.column("n").to_numpy().astype(float)
    weight = np.log((b + 0.5) / (n_bad + 1)) - np.log((n - b + 0.5) / (n_good + 1))
    return top.column("word").to_numpy().view(np.uint64), np.clip(weight, 0, 6)


def _evidence(model, prior: float):
    words, weights, cuts, beta = model

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _inputs(words, weights)
        for batch in slices(batches):
            x = inputs(encoded(batch.column("text").to_pylist()))
            odds = np.clip(_binned(x, cuts) @ beta, -20, 20) - prior if len(beta) else np.zeros(batch.num_rows)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(odds)], names=[*kept, "evidence"])

    return evidence


def _strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-counts of the prior: how far groups differ from `rate` beyond what counting explains."""
    expected = rate * (1 - rate) * F.col("n")
    spread = F.pow(F.col("s") - F.col("n") * rate, 2)
    a, b, c = groups.agg(F.sum(spread), F.sum(expected), F.sum(rate * (1 - rate) * F.col("n") * (F.col("n") - 1))).first()
    if not a or not c:
        return STRENGTH[1]
    correlation = (a - b) / c  # of two documents of one group: 1 / (strength + 1)
    return float(np.clip(1 / max(correlation, 1e-9) - 1, *STRENGTH))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, host, path, evidence (log odds), host_rate, path_rate, p_bad, kept (p_bad < 0.5).

    A labelled document is bad if its quality is 0 or it is toxic; several labels count as the worst, missing ones as good. Missing
    hosts and paths are a group each. A missing text is an empty one. Without labels of both kinds there is no evidence and every document stays.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.col(text_col).alias("text"),
    )
    bad = (F.coalesce(F.col(good_col), F.lit(1)) == 0) | (F.coalesce(F.col(toxic_col), F.lit(0)) == 1)
    sample = labels.select(F.col(id_col).cast("long").alias("doc_id"), bad.alias("bad")).dropna().groupBy("doc_id").agg(F.max("bad").alias("bad"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # The broadcast side has at most SAMPLE_ROWS rows of 9 bytes.
    taught = durable(named.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "bad"))
    total, n_bad = (int(x or 0) for x in taught.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first())
    words, weights = telltale(taught.select("text", "bad").mapInArrow(_word_counts, "word long, n_bad long, n_all long"), n_bad, total - n_bad)
    cuts, beta, prior = [], np.empty(0), 0.0
    if 0 < n_bad < total:
        inputs = _inputs(words, weights)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                x = inputs(encoded(batch.column("text").to_pylist()))
                yield pa.record_batch([batch.column("doc_id"), batch.column("bad"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "bad", "x"])

        fitted = taught.mapInArrow(vectors, "doc_id long, bad boolean, x array<double>").orderBy("doc_id", "x").limit(SAMPLE_ROWS).toArrow()
        x = np.array(fitted.column("x").to_pylist())
        prior = float(np.log(n_bad / (total - n_bad)))
        cuts, beta = fit(x, fitted.column("bad").to_numpy(zero_copy_only=False).astype(bool))

    scored = durable(named.mapInArrow(_evidence((words, weights, cuts, beta), prior), "doc_id long, text_hash long, host string, path string, evidence double"))
    scored = scored.withColumn("p", _sigmoid(F.col("evidence") + prior))
    sums = (F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    paths = durable(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    s, n = paths.agg(F.sum("s"), F.sum("n")).first()
    rate = min(max((s or 0.5) / (n or 1), 1e-6), 1 - 1e-6)
    by_host = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"))
    hosted = paths.join(hosts, "host").withColumn("host_rate", (F.col("host_s") + by_host * rate) / (F.col("host_n") + by_host))
    by_path = _strength(hosted, F.col("host_rate"))
    joined = scored.join(hosted, ["host", "path"])
    # Without the document itself, in both levels.
    host_rate = (F.col("host_s") - F.col("p") + by_host * rate) / (F.col("host_n") - 1 + by_host)
    path_rate = (F.col("s") - F.col("p") + by_path * F.col("host_rate")) / (F.col("n") - 1 + by_path)
    p_bad = _sigmoid(F.col("evidence") + _logit(F.col("path_rate"))) if len(beta) else F.lit(0.0)
    return (
        joined.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("p_bad", p_bad)
        .select("doc_id", "text_hash", "host", "path", *[F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "p_bad")], (F.col("p_bad") < 0.5).alias("kept"))
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    judged = classify(docs, labels, id_col, text_col, **columns)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    own = F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.col(text_col)) == F.col("_gone_hash"))
    return docs.join(gone, own, "left_anti")
