"""Query registration, and SQL spellings of the operators for the checking engine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.bindings import ENC_SQL, PATIENTS_SQL, REGISTRY_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` computes the same columns on the same tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_enc(sql: str) -> str:
    return f"WITH enc AS (\n{ENC_SQL})\n{sql}"


def with_registry(sql: str) -> str:
    return f"WITH reg AS (\n{REGISTRY_SQL})\n{sql}"


MONTHS = "round(date_diff('day', start_date, end_date) / 30.5, 1)"


def with_patients(sql: str) -> str:
    return (
        f"WITH patients AS ({PATIENTS_SQL}),\n"
        f"pat AS (SELECT p.*, CAST({MONTHS} AS DOUBLE) AS months, c_acctbal, c_mktsegment\n"
        f" FROM patients p LEFT JOIN customer ON c_custkey = hosp_id)\n{sql}"
    )


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits that two engines agree on."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_recode(col: str, mapping: Mapping[str, str]) -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {col} END"


def sql_sequential(col: str, steps: Iterable[tuple[str, str]]) -> str:
    for code, word in steps:
        col = f"replace({col}, {quoted(code)}, {quoted(word)})"
    return col


def sql_flag(col: str, pattern: str) -> str:
    return f"CASE WHEN coalesce(regexp_matches({col}, {quoted('(?is)' + pattern)}), false) THEN 'Yes' ELSE 'No' END"


def sql_cascade(out: str, text: str, rules: Iterable[tuple[str, str]], options: str = "(?s)") -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, {quoted(options + p)}) THEN {quoted(v)}" for p, v in rules)
    return f"coalesce({out}, CASE {arms} END)"


def sql_label(col: str, labels: Mapping[int, str]) -> str:
    arms = " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in labels.items())
    return f"CASE {col} {arms} END"
