"""URL rules and a Bloom filter cascade, in DataFrame functions only.

Level 1 of the cascade holds the listed keys; level 2 the keys of the corpus that pass level 1 though they aren't listed; level 3 the listed keys
that pass level 2, and so on until nothing passes wrongly. A key is judged by the first level that it fails, so for every key of the
corpus the answer is exact, and the urls are judged in one scan without a join. The levels are bit arrays of about 1.44 log2(1 / p) bits a key,
held in one-row tables that the judging plan reads as scalar subqueries. Their size is checked before they are built; a list beyond `MAX_BYTES` is joined instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import durable

MAX_BYTES = 64_000_000
#: Levels after which the cascade would be no smaller than the keys themselves; never reached with independent hashes.
MAX_LEVELS = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule, written host/path, that fits the host or a parent domain and the beginning of the path; NULL if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def _shape(n_keys: int, rate: float) -> tuple[int, int]:
    """Hash functions and 64-bit words of a Bloom filter."""
    hashes = max(1, round(math.log2(1 / rate)))
    return hashes, max(1, math.ceil(n_keys * hashes / math.log(2) / 64))


class Level:
    """A Bloom filter as a one-row table of 64-bit words. Its size is to be checked before."""

    def __init__(self, keys: DataFrame, number: int, n_keys: int, rate: float):
        self.number = number
        self.hashes, self.words = _shape(n_keys, rate)
        spark = keys.sparkSession
        places = keys.select(F.explode(F.array(*[self._place(F.col("key"), j) for j in range(self.hashes)])).alias("place"))
        bits = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        every = spark.range(self.words).withColumnRenamed("id", "word").join(bits, "word", "left")
        ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        self.table = durable(every.agg(F.transform(ordered, lambda x: x["bits"]).alias("bits")))

    def _place(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number * 64 + j)), F.lit(self.words * 64))

    def passes(self, key: Column) -> Column:
        on = F.lit(True)
        for j in range(self.hashes):
            place = self._place(key, j)
            word = F.get(self.table.scalar(), F.shiftright(place, 6).cast("int"))
            on = on & (F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return on


class Cascade:
    """Exact membership for the keys of `universe`. `listed` and `universe` have a column key; missing keys belong to neither."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = durable(listed.select("key").dropna().distinct())
        others = durable(universe.select("key").dropna().distinct().join(listed, "key", "left_anti"))
        self.levels: list[Level] = []
        n_in, n_out = listed.count(), others.count()
        inside, outside, size = listed, others, 0
        self.listed: DataFrame | None = None
        while n_in:
            # The first level passes about as many others as there are listed keys, each later one half.
            rate = min(0.5, n_in / max(1, n_out)) if not self.levels else 0.5
            size += 8 * _shape(n_in, rate)[1]
            if size > MAX_BYTES or len(self.levels) >= MAX_LEVELS:
                self.levels, self.listed = [], listed
                return
            level = Level(inside, len(self.levels) + 1, n_in, rate)
            self.levels.append(level)
            wrong = durable(outside.where(level.passes(F.col("key"))))
            inside, outside, n_in = wrong, inside, wrong.count()

    def add_membership(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """`df` with a boolean column: whether the key is listed."""
        if self.listed is not None:
            listed = self.listed.select(F.col("key").alias("_listed_key"))
            return df.join(listed, F.col(key) == F.col("_listed_key"), "left").withColumn(out, F.col("_listed_key").isNotNull()).drop("_listed_key")
        verdict = F.lit(len(self.levels) % 2 == 1)  # of a key that passes every level
        for level in reversed(self.levels):
            verdict = F.when(~level.passes(F.col(key)), F.lit(level.number % 2 == 0)).otherwise(verdict)
        return df.withColumn(out, F.coalesce(verdict, F.lit(False)))


def judge(urls: DataFrame, url_col: str, allow: Sequence[str], block: Sequence[str], listed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep`, and host, path, rule, verdict: the rule's, else block if the host is listed (a table with a column key), else allow.

    The host is what follows the first :// up to the first of / ? # with A-Z in lower case, the path what follows up to ? or #; a missing url or one without
    :// has neither. Repeated rows are judged alike, an empty table gives no rows. Columns of `keep` must not be named host, path, rule, verdict or _listed; other columns are ignored.
    """
    parsed = urls.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    cascade = Cascade(listed, parsed.select(F.col("host").alias("key")))
    member = cascade.add_membership(parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block])), "host", "_listed")
    by_rule = F.when(F.col("rule").isin(*allow), "allow").when(F.col("rule").isin(*block), "block")
    verdict = F.coalesce(by_rule, F.when(F.col("_listed"), "block").otherwise("allow"))
    return member.select(*keep, "host", "path", "rule", verdict.alias("verdict"))
