"""Encounter CSV in, review lists and snapshots out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.durable import durable

# One split is 128 MB of input or one file: this many are a table of some 100 MB.
BROADCAST_SPLITS = 500_000


def read_encounters(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    rename: Mapping[str, str],
    casts: Mapping[str, Column | str] | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """Scan CSV files with a header into text columns, blank and `NA` cells as NULL.

    `columns` are the file's columns in file order; they are renamed by `rename` and cast by
    `casts` (a type name, or an expression over the renamed columns).  `ingest_id` numbers the
    rows from 0 in file order, files sorted by path, however the scan is split.  The result is
    a durable copy, because the numbers must not change when a plan is run again.

    Quoted cells may hold separators, doubled quotes and line breaks; a quoted blank is missing too. A record with too many or too few cells
    is an error. `line_breaks=False` is for exports known to have none inside cells: their files can be split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema)
        .options(
            header=True,
            quote='"',
            escape='"',
            multiLine=line_breaks,
            mode="FAILFAST",
            nullValue="NA",
            ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True,
            enforceSchema=False,
        )
        .csv(path)
    )
    renamed = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(rename.get(c, c)) for c in columns]
    scan = durable(
        raw.select(
            *renamed,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_seen"),
        )
    )
    # The rows of one split are consecutive in `_seen`.
    splits = scan.groupBy("_file", "_start").agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = durable(
        splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    numbered = scan.join(splits, ["_file", "_start"]).withColumn(
        "ingest_id", F.col("_seen") - F.col("_first") + F.col("_offset")
    )
    table = numbered.select("ingest_id", *[rename.get(c, c) for c in columns])
    for name, cast in (casts or {}).items():
        value = F.col(name).try_cast(cast) if isinstance(cast, str) else cast
        table = table.withColumn(name, value)
    return table


def write_review(df: DataFrame, path: str) -> None:
    """A list for data entry: CSV with a header, missing as `NA`; quotes in quoted cells are doubled."""
    df.write.mode("overwrite").options(header=True, nullValue="NA", quote='"', escape='"').csv(path)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The whole table, as Parquet or as CSV like `write_review`."""
    if fmt == "csv":
        write_review(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
