"""A corpus pipeline: documents that pass quality rules and the classifier, one of each group of near copies, without repeated passages, packed.

Each stage takes (spark, docs, folder of tables) and returns a table that is written as Parquet and read again as the next one's documents.
All but the last return the columns of documents. Labels to learn from are read from the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.llm import ngram_join, packing, quality_rules, site_classifier, suffix_dedup
from cohortline.operators.durable import durable


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a learned rule rejects."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than bad, by their text and the record of their source."""
    return site_classifier.keep_good(docs, _labels(spark, sf_dir))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return ngram_join.near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand in one with a smaller id; n_chars is that of the rest."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    named = docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("_missing")).alias("_row"))
    cut = suffix_dedup.remove_repeats(named, with_text=True, keep=("_row",))
    text = F.when(~F.col("_row._missing"), F.col("kept_text"))
    values = {"text": text, "n_chars": F.coalesce(F.char_length(text).cast("long"), F.lit(0).cast("long"))}
    return cut.select(*[values.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("packing", packed),
]

#: Learning, components and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
