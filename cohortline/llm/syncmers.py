"""Document fingerprints of closed syncmers, in DataFrame functions only.

The letters are the words of a text (runs other than 0x20 and 0x09-0x0D), hashed. A run of K words is a closed syncmer if the least of its
S-word runs stands at its first or last place. That depends on the K words alone, so a passage has the same anchors wherever it lies, up to its
last words. A text too short to be sure of an anchor and without one (up to K + K - S - 2 words) is its own anchor, the hash of all its words. The fingerprint
is the SKETCH least different anchor hashes; likeness estimates the Jaccard similarity of the anchor sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.durable import durable

K, S = 8, 2
SKETCH = 128
#: S-word runs in K words.
_INNER = K - S + 1
_NO_ID = -(1 << 63)


def _ahead(name: str, n: int) -> Column:
    """The array from its n-th next entry on."""
    return F.slice(F.col(name), n + 1, F.greatest(F.size(name) - n, F.lit(0)))


def _paired(name: str, n: int, how) -> Column:
    """Each entry with the one n places on, as far as there is one."""
    own = F.slice(F.col(name), 1, F.greatest(F.size(name) - n, F.lit(0)))
    return F.zip_with(own, _ahead(name, n), how)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: for each K-word run in order, its hash if it is a closed syncmer, else NULL.

    A text of 1 to K - 1 words has one entry, the hash of all; one without words has none. Where K words or more hold no closed syncmer,
    the first entry is the hash of all words.
    """
    t = f"_{out}"
    words = F.filter(F.split(F.col(text), "[ \\t-\\r]+"), lambda w: w != "")
    kept = [c for c in df.columns]
    df = df.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias(f"{t}w"))
    # Each step has a projection of its own, so that no array is computed twice.
    df = df.select(*kept, f"{t}w", _paired(f"{t}w", 1, _hash).alias(f"{t}a"))
    df = df.select(*kept, f"{t}w", f"{t}a", _paired(f"{t}a", 1, _least).alias(f"{t}m"))
    df = df.select(*kept, f"{t}w", f"{t}a", _paired(f"{t}m", 2, _least).alias(f"{t}m"))
    df = df.select(*kept, f"{t}w", f"{t}a", _paired(f"{t}m", _INNER - 4, _least).alias(f"{t}m"), _paired(f"{t}a", 2, _hash).alias(f"{t}h"))
    df = df.select(
        *kept,
        f"{t}w",
        F.zip_with(_paired(f"{t}a", _INNER - 1, _least), F.col(f"{t}m"), lambda edge, least: edge == least).alias(f"{t}e"),
        _paired(f"{t}h", 4, _hash).alias(f"{t}h"),
    )
    full = F.zip_with(F.col(f"{t}h"), F.col(f"{t}e"), lambda h, e: F.when(e, h))
    df = df.select(*kept, f"{t}w", full.alias(f"{t}f"))
    whole, n = F.xxhash64(F.col(f"{t}w")), F.size(f"{t}w")
    anchored = F.exists(F.col(f"{t}f"), lambda h: h.isNotNull())
    alone = F.transform(F.col(f"{t}f"), lambda h, i: F.when(i == 0, whole))
    return df.select(
        *kept, F.when(anchored, F.col(f"{t}f")).when(n >= K, alone).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>")).alias(out)
    )


def same_place(a: Column, b: Column) -> Column:
    """Share of the anchors of `a` that stand at the same word of `b`, 1 where there is none in either.

    An anchor depends on its own words alone, so two texts have the same anchors in a shared beginning, each at its place, up to the last words before they part.
    """
    both = F.size(F.array_compact(F.zip_with(a, b, lambda x, y: F.when(x == y, 1))))
    n, other = F.size(F.array_compact(a)), F.size(F.array_compact(b))
    return F.when(n > 0, both / n).when(other == 0, 1.0).otherwise(0.0)


def sketch(anchors: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.array_compact(anchors))), 1, SKETCH)


def as_text(values: Column) -> Column:
    """A sketch as a string: 8 hexadecimal digits an entry."""
    return F.array_join(F.transform(values, lambda h: F.lpad(F.hex(F.shiftrightunsigned(h, 32)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, from 0 to 1; 1 for two empty ones."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def following(docs: DataFrame) -> DataFrame:
    """For each different key k: the next key in ascending order (the first after the last), its text's hash, and the most characters needed of it.

    `docs` has k, text_hash and need. Keys are sorted by range, never in one task; of the ranges only their first keys are looked at together.
    """
    order = docs.groupBy("k").agg(F.min("text_hash").alias("rep"), F.max("need").alias("need"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(order.repartitionByRange(parts, "k").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min(F.struct("k", "rep")).alias("first"))
    by_range = Window.orderBy("range")  # one row for each shuffle partition
    firsts = firsts.select("range", F.lead("first").over(by_range).alias("next_first"), F.min("first").over(Window.partitionBy()).alias("very_first"))
    inside = F.lead(F.struct("k", "rep")).over(Window.partitionBy("range").orderBy("k"))
    following = F.coalesce("inside", "next_first", "very_first")
    return durable(
        ranged.withColumn("inside", inside)
        .join(F.broadcast(firsts), "range")
        .select("k", "need", following["k"].alias("next_k"), following["rep"].alias("next_rep"))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the next document. A missing text is empty;
    its fingerprint is an empty string. The next document is that with the next larger id, the first after the last; a missing id comes first, and of rows with the same id
    the one with the least hash of its text stands for all. Other columns are ignored, whatever their names; repeated rows are returned as they are, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("k"), text.alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    order = following(texts.select("k", F.xxhash64("text").alias("text_hash"), quarter.alias("need")))
    ask = order.select(F.col("k").alias("ask_k"), "need", "next_k", "next_rep")
    # Both joins take `texts` by k with the same columns, so texts are shuffled once; the hash is no join key for that reason. A text's sketch is made again where it is the next
    # one, and goes with its first characters, so that sketches are shuffled once and never written.
    heads = texts.join(ask, F.col("k") == F.col("next_k")).where(F.xxhash64("text").bitwiseXOR(F.col("next_rep")) == 0)
    heads = with_anchors(heads.select("ask_k", "text", F.expr("substring(text, 1, need)").alias("head")), "text", "own")
    heads = heads.groupBy("ask_k").agg(F.first("head").alias("head"), F.first(sketch(F.col("own"))).alias("next_own"))
    full = texts.join(heads, F.col("k") == F.col("ask_k"))
    edited = F.expr("concat(substring(text, 1, n_chars - need), substring(head, 1, need))")
    full = full.withColumn("n_chars", F.char_length("text")).withColumn("need", quarter).select("k", "n_chars", "text", edited.alias("edited"), "next_own")
    marked = with_anchors(full, "text", "own").select("k", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "next_own", sketch(F.col("own")).alias("own"))
    marked = with_anchors(marked, "edited", "other").drop("edited").withColumn("other", sketch(F.col("other")))
    return marked.select(
        F.nullif(F.col("k"), F.lit(_NO_ID)).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
