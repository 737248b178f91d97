"""The driver's tables seen as encounter tables.

They hold no clinical records and no missing values.  The expressions below put encounter
columns on every row of `events` and `orders`, and blank or garble some cells by the row's
number.  They are SQL that Spark and the checking engine read alike, and no row is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import dictionaries as d


def pick(index: str, values: Sequence[str | None]) -> str:
    """The value at the row's index, by array lookup; None is missing."""
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({items}), CAST(1 + ({index}) % {len(values)} AS INT))"


def for_checker(sql: str) -> str:
    """The same expression for the checking engine, whose array functions have other names."""
    return sql.replace("element_at(array(", "list_extract(list_value(")


# `events` as encounters of a user: many rows a day, so duplicates and short gaps abound.
ENC = {
    "ingest_id": "event_id",
    "hosp_id": "user_id",
    "pat_name": "concat('P', CAST(user_id AS STRING), CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '' END)",
    "e_date": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(ts AS DATE) END",
    "iv_date": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END",
    "dx_date": "CASE WHEN user_id % 10 = 9 THEN NULL WHEN event_id % 3 = 0 THEN NULL"
    " WHEN user_id % 5 = 0 THEN CAST(ts AS DATE) ELSE DATE '2024-01-05' END",
    "encounter_type": "CASE WHEN event_type = 'signup' THEN 'Initial' WHEN event_type = 'error' THEN NULL"
    " ELSE 'Return' END",
    "creatinine_raw": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END",
    "hgb": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 10.0 END",
    "albumin": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(30 + event_id % 20 AS DOUBLE) END",
    "calcium": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE 2.0 + value / 100.0 END",
    "complaint_codes": "CASE WHEN event_id % 13 = 0 THEN NULL"
    " ELSE concat(CAST(event_id % 16 AS STRING), ';', CAST(user_id % 15 AS STRING)) END",
    "regimen_a": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 17 AS STRING) END",
    "regimen_b": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id % 17 AS STRING) END",
    "remission_plan": "CASE WHEN event_id % 10 < 6 THEN NULL WHEN event_id % 10 = 9 THEN 'stop all medications'"
    " ELSE CAST(event_id % 5 AS STRING) END",
    "on_remission": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE event_id % 3 = 0 END",
    "remission_date": "CASE WHEN event_id % 6 = 1 THEN CAST(ts AS DATE) END",
    "notes": "CASE WHEN event_id % 4 = 3 THEN NULL ELSE concat(event_type, ' ', props) END",
    "ecog_index": "CASE WHEN event_id % 15 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END",
    "regimen_c": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE '2;7' END",
    "m_component": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 2.0 END",
    "birth_year": "CASE WHEN user_id % 13 = 0 THEN NULL ELSE CAST(1930 + user_id % 60 AS INT) END",
    "death_date": "CASE WHEN event_id % 11 = 0 THEN CAST(ts AS DATE) END",
    "outcome": pick("event_id", ["Alive", "LTFU", "deceased", "DECEASED", "Deceased", None, "Alive"]),
    "pain_codes": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat(CAST(event_id % 8 AS STRING), ';limb ',"
    " CAST(user_id % 6 AS STRING)) END",
    "sign_codes": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 7 AS STRING) END",
    "bleeding_site": pick("event_id", [*d.BLEEDING_SITES, None, "Nose", "nose"]),
    "swelling_site": pick("event_id", [*d.SWELLING_SITES, None, "ll", "Knee"]),
    "date_text": "concat(CAST(month(ts) AS STRING), '/', CAST(CASE WHEN event_id % 20 = 0 THEN 31 + event_id % 7"
    " ELSE day(ts) END AS STRING), '/', CAST(year(ts) AS STRING), CASE WHEN event_id % 6 = 0 THEN ' 10:00' ELSE '' END)",
}

# `orders` as a registry export: some ten encounters per customer over six years.
_PHRASES = [f"Review: {p.rstrip('.')} 50 mg daily" for p, _ in dict.fromkeys(d.NOTE_RULES)]
_PHRASES += [p.rstrip(".") for p, _ in d.NOTE_RULES if p.endswith(".")]
_PHRASES += [f"For {w.upper()} review" for w in d.MAINTENANCE_NOTES_INTENT.split("|")]
REGISTRY = {
    "ingest_id": "o_orderkey",
    "hosp_id": "CASE WHEN o_orderkey % 499 = 0 THEN NULL ELSE o_custkey END",
    "pat_name": "concat('P', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE '' END)",
    "e_date": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "iv_date": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "death_date": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 30 END",
    "dx_date": "CASE WHEN o_custkey % 10 = 9 OR o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "birth_year": "CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE CAST(1920 + o_custkey % 50 AS INT) END",
    "encounter_type": "CASE WHEN o_orderkey % 7 = 0 THEN 'Initial' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Return' END",
    "outcome": "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'LTFU'"
    " WHEN o_orderstatus = 'O' THEN 'Alive' ELSE " + pick("o_orderkey", ["deceased", "DECEASED", "Deceased"]) + " END",
    "creatinine_raw": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(50 + (o_orderkey * 7) % 200 AS DOUBLE) END",
    "hgb": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(6 + o_orderkey % 9 AS DOUBLE) END",
    "albumin": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(30 + o_orderkey % 20 AS DOUBLE) END",
    "calcium": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(200 + o_orderkey % 100 AS DOUBLE) / 100 END",
    "m_component": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END",
    "complaint": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 12 = 0 THEN 'Fatique and BONE pain for 2 weeks'"
    " ELSE concat(CAST(o_orderkey % 16 AS STRING), ';', CAST(o_custkey % 15 AS STRING)) END",
    "pain_site": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS STRING) END",
    "signs": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS STRING) END",
    "bleeding_site": pick("o_orderkey", [*d.BLEEDING_SITES, None, "Nose", "nose"]),
    "swelling_site": pick("o_orderkey", [*d.SWELLING_SITES, None, "ll", "Knee"]),
    "ecog_index": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END",
    "regimen_start": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE " + pick("o_custkey", list(d.REGIMENS)) + " END",
    "regimen_cont": "CASE WHEN o_orderkey % 3 < 2 THEN NULL ELSE CAST(o_orderkey % 9 AS STRING) END",
    "regimen_chemo": pick("o_orderkey", [None, None, None, None, "1", "5", None, "VTD, VTD"]),
    "cycle_start": pick("o_orderkey", [None, "C1", "C2"]),
    "cycle_cont": pick("o_custkey", [None, "C3", None, "C4"]),
    "cycle_chemo": pick("o_orderkey", [None, "C5", None, None, "C6"]),
    "notes": pick("o_orderkey", [*_PHRASES, None, "No change"]),
    "remission_plan": pick("o_custkey + o_orderkey", [*d.REMISSION_CODES, *d.REMISSION_PLANS, d.STOP_PLAN, *[None] * 8]),
    "remission_date": "CASE WHEN o_orderkey % 6 = 1 THEN CAST(o_orderdate AS DATE) END",
    "on_remission": "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END",
}
REGISTRY_COHORT = ("1995-06-01", "1999-12-31")
# An invented correction: this customer's diagnosis date.
REGISTRY_CORRECTIONS = {17: "1996-05-27"}


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ",\n ".join(f"{for_checker(e)} AS {n}" for n, e in columns.items()) + f"\nFROM {table}"


ENC_SQL = _select(ENC, "events")
REGISTRY_SQL = _select(REGISTRY, "orders")
PATIENTS_SQL = """
SELECT o_custkey AS hosp_id,
 min(CAST(o_orderdate AS DATE)) AS start_date,
 max(CAST(o_orderdate AS DATE)) AS end_date,
 count(*) AS n_orders,
 CASE WHEN arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) = 'F' THEN 1 ELSE 0 END AS status
FROM orders GROUP BY o_custkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as encounters."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in ENC.items()])


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a registry export."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in REGISTRY.items()])


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their first and last order, and whether the last one has status F."""
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("hosp_id"))
    return grouped.agg(
        F.min(F.col("o_orderdate").cast("date")).alias("start_date"),
        F.max(F.col("o_orderdate").cast("date")).alias("end_date"),
        F.count(F.lit(1)).alias("n_orders"),
        F.when(last == "F", 1).otherwise(0).alias("status"),
    )
