"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import frames, longitudinal as lg, quality as q
from ..operators.durable import scratch_folder
from ..plans.bindings import enc
from ..sources import encounters as src
from .base import query, with_enc

_DATES = ["iv_date", "e_date", "encounter_type", "dx_date", "death_date"]
_KEYS = ["hosp_id", "pat_name"]


@query(
    "missing_rows",
    with_enc(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", ingest_id FROM enc WHERE {c} IS NULL" for c in _DATES
        )
    ),
)
def missing_rows(spark, sf):
    return q.missing_rows(enc(spark, sf), _DATES)


@query(
    "missing_counts",
    with_enc(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count({c}) AS n_present FROM enc"
            for c in _DATES
        )
    ),
)
def missing_counts(spark, sf):
    return q.missing_counts(enc(spark, sf), _DATES)


_KINDS = "SELECT hosp_id FROM enc GROUP BY hosp_id HAVING count(DISTINCT dx_date) + max(CAST(dx_date IS NULL AS INT))"


@query("keys_consistent", with_enc(f"{_KINDS} = 1"))
def keys_consistent(spark, sf):
    return q.keys_consistent(enc(spark, sf), "hosp_id", "dx_date")


@query("keys_conflicting", with_enc(f"{_KINDS} > 1"))
def keys_conflicting(spark, sf):
    return q.keys_conflicting(enc(spark, sf), "hosp_id", "dx_date")


@query("distinct_keys", with_enc("SELECT DISTINCT hosp_id FROM enc"))
def distinct_keys(spark, sf):
    return frames.distinct_keys(enc(spark, sf), "hosp_id")


@query(
    "duplicate_rows",
    with_enc("""SELECT ingest_id, hosp_id, pat_name, e_date FROM (
 SELECT *, row_number() OVER (PARTITION BY hosp_id, pat_name, e_date ORDER BY ingest_id) AS rn FROM enc
) WHERE rn > 1"""),
)
def duplicate_rows(spark, sf):
    rows = enc(spark, sf).select("ingest_id", *_KEYS, "e_date")
    return q.duplicate_rows(rows, _KEYS, "e_date")


@query(
    "duplicate_recheck",
    with_enc(""", kept AS (
 SELECT * FROM enc QUALIFY row_number() OVER (PARTITION BY hosp_id, pat_name, e_date ORDER BY ingest_id) = 1)
SELECT count(*) AS n_left, (SELECT count(*) FROM (
  SELECT 1 FROM kept QUALIFY row_number() OVER (
   PARTITION BY hosp_id, pat_name, e_date ORDER BY pat_name, e_date, ingest_id) > 1)) AS n_duplicates
FROM kept"""),
)
def duplicate_recheck(spark, sf):
    rows = enc(spark, sf).select("ingest_id", *_KEYS, "e_date")
    kept = lg.dedup_keep_first(rows, [*_KEYS, "e_date"])
    again = q.duplicate_rows(kept, _KEYS, "e_date").select(F.lit(1).alias("dup"), F.lit(0).alias("kept"))
    both = kept.select(F.lit(0).alias("dup"), F.lit(1).alias("kept")).unionByName(again)
    return both.agg(F.sum("kept").alias("n_left"), F.sum("dup").alias("n_duplicates"))


@query(
    "repeated_label",
    with_enc("""SELECT ingest_id, hosp_id, pat_name, encounter_type FROM (
 SELECT *, row_number() OVER (PARTITION BY hosp_id, pat_name, encounter_type ORDER BY ingest_id) AS rn FROM enc
) WHERE rn > 1 AND encounter_type = 'Initial'"""),
)
def repeated_label(spark, sf):
    rows = enc(spark, sf).select("ingest_id", *_KEYS, "encounter_type")
    return q.repeated_label(rows, _KEYS, "encounter_type", "Initial")


@query(
    "negative_duration",
    with_enc("""SELECT ingest_id, hosp_id, date_diff('day', dx_date, e_date) AS days FROM enc
WHERE date_diff('day', dx_date, e_date) < 0"""),
)
def negative_duration(spark, sf):
    rows = enc(spark, sf).select(
        "ingest_id", "hosp_id", F.datediff("e_date", "dx_date").cast("long").alias("days")
    )
    return q.negative_duration(rows, "days")


_CSV = {"Hosp_ID": "hosp_id", "Pat_Name": "pat_name", "E_Date": "e_date", "Encounter_Type": "encounter_type", "HgB_g/dl": "hgb"}


@query("csv_round_trip", with_enc("SELECT hosp_id, pat_name, e_date, encounter_type, hgb FROM enc"))
def csv_round_trip(spark, sf):
    """Write encounters as the registry's CSV export, scan it again and type it."""
    rows = enc(spark, sf).withColumn("e_date", F.date_format("e_date", "M/d/yyyy"))
    path = scratch_folder(spark) + "/encounters"
    src.write_snapshot(rows.select(*[F.col(c).alias(name) for name, c in _CSV.items()]), path, "csv")
    casts = {"hosp_id": "bigint", "hgb": "double", "e_date": dates.parse_date(F.col("e_date"))}
    return src.read_encounters(spark, path, list(_CSV), _CSV, casts).drop("ingest_id")


_NOTES = {"Hosp_ID": "hosp_id", "Notes": "notes", "Plan": "plan"}


@query(
    "csv_quoted_round_trip",
    with_enc("""SELECT row_number() OVER (ORDER BY ingest_id) - 1 AS ingest_id, hosp_id,
 CASE ingest_id % 5 WHEN 0 THEN NULL ELSE notes || chr(10) || 'says "on TD, now" ok' END AS notes,
 CASE WHEN ingest_id % 3 > 0 THEN remission_plan END AS plan FROM enc"""),
)
def csv_quoted_round_trip(spark, sf):
    """Free text with line breaks, separators, quotes and quoted blanks, written as CSV and scanned again."""
    note = F.concat("notes", F.lit('\nsays "on TD, now" ok'))
    rows = enc(spark, sf).select(
        F.col("ingest_id").alias("_order"),
        F.col("hosp_id").alias("Hosp_ID"),
        F.when(F.col("ingest_id") % 5 == 0, "").otherwise(note).alias("Notes"),
        F.when(F.col("ingest_id") % 3 > 0, F.col("remission_plan")).alias("Plan"),
    )
    path = scratch_folder(spark) + "/notes"
    src.write_snapshot(rows.repartitionByRange("_order").sortWithinPartitions("_order").drop("_order"), path, "csv")
    return src.read_encounters(spark, path, list(_NOTES), _NOTES, {"hosp_id": "bigint"})


@query(
    "write_review",
    with_enc("""SELECT hosp_id, pat_name, dx_date FROM enc WHERE hosp_id IN (
 SELECT hosp_id FROM enc GROUP BY hosp_id HAVING count(DISTINCT dx_date) + max(CASE WHEN dx_date IS NULL THEN 1 ELSE 0 END) > 1)"""),
)
def write_review(spark, sf):
    """The rows of patients with conflicting dates of diagnosis as a list for data entry, read back."""
    rows = enc(spark, sf).select("hosp_id", "pat_name", F.date_format("dx_date", "M/d/yyyy").alias("dx_date"))
    keys = q.keys_conflicting(rows, "hosp_id", "dx_date")
    path = scratch_folder(spark) + "/review"
    src.write_review(rows.join(keys.select("hosp_id"), "hosp_id", "left_semi"), path)
    columns = ["hosp_id", "pat_name", "dx_date"]
    casts = {"hosp_id": "bigint", "dx_date": dates.parse_date(F.col("dx_date"))}
    return src.read_encounters(spark, path, columns, {}, casts).drop("ingest_id")
