"""Per-subject repair, on ordinary and on hot keys."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortline.operators import chain, frames, longitudinal as lg, quality as q, skew
from cohortline.plans.bindings import enc

HOT = [10**6, 1]  # rows from which a key counts as hot: none, and nearly all
SF = "/root/testdata/sf0.001"


def day(text):
    return None if text is None else date.fromisoformat(text)


def rows_of(df, *cols):
    return [tuple(r) for r in df.orderBy("ingest_id").select(*cols).collect()]


@pytest.mark.parametrize("hot_rows", HOT)
def test_fill_from_group_min(spark, hot_rows):
    data = [
        (1, 1, day("2020-01-05"), None),
        (2, 1, day("2020-01-02"), day("2020-01-09")),
        (3, 2, None, None),
        (4, None, day("2020-03-01"), None),
        (5, None, day("2020-02-01"), None),
    ]
    df = spark.createDataFrame(data, "ingest_id long, hosp_id long, e_date date, iv_date date")
    out = lg.fill_from_group_min(df, "hosp_id", "iv_date", "e_date", hot_rows=hot_rows)
    assert [r[0] for r in rows_of(out, "iv_date")] == [
        day("2020-01-02"), day("2020-01-09"), None, day("2020-02-01"), day("2020-02-01"),
    ]


@pytest.mark.parametrize("hot_rows", HOT)
def test_own_minimum_harmonise_and_key_checks(spark, hot_rows):
    data = [(1, 1, day("2020-05-01")), (2, 1, day("2020-04-01")), (3, 2, day("2020-06-01")), (4, 2, None), (5, 3, None)]
    df = spark.createDataFrame(data, "ingest_id long, hosp_id long, dx_date date")
    filled = lg.fill_from_group_min(df, "hosp_id", "dx_date", hot_rows=hot_rows)
    assert [r[0] for r in rows_of(filled, "dx_date")] == [
        day("2020-05-01"), day("2020-04-01"), day("2020-06-01"), day("2020-06-01"), None,
    ]
    same = lg.harmonise_to_min(filled, "hosp_id", "dx_date", hot_rows=hot_rows)
    assert [r[0] for r in rows_of(same, "dx_date")] == [
        day("2020-04-01"), day("2020-04-01"), day("2020-06-01"), day("2020-06-01"), None,
    ]
    assert sorted(r[0] for r in q.keys_conflicting(df, "hosp_id", "dx_date").collect()) == [1, 2]
    assert [r[0] for r in q.keys_consistent(df, "hosp_id", "dx_date").collect()] == [3]
    assert q.keys_conflicting(same, "hosp_id", "dx_date").count() == 0


def test_corrections(spark):
    data = [(1, 1001, day("2020-01-01")), (2, 5, day("2020-01-01")), (3, None, day("2020-01-01"))]
    df = spark.createDataFrame(data, "ingest_id long, hosp_id long, dx_date date")
    fix = {1001: date(2015, 5, 27)}
    out = frames.apply_corrections(df, "hosp_id", "dx_date", fix)
    assert [r[0] for r in rows_of(out, "dx_date")] == [day("2015-05-27"), day("2020-01-01"), None]
    kept = frames.apply_corrections(df, "hosp_id", "dx_date", fix, intent=True)
    assert [r[0] for r in rows_of(kept, "dx_date")][2] == day("2020-01-01")


@pytest.mark.parametrize("hot_rows", HOT)
def test_dedup_and_duplicates(spark, hot_rows):
    data = [
        (1, 1, "A", day("2020-01-01")),
        (2, 1, "A", day("2020-01-01")),
        (3, 1, "B", day("2020-01-01")),
        (4, 1, "A", None),
        (5, 1, "A", None),
    ]
    df = spark.createDataFrame(data, "ingest_id long, hosp_id long, pat_name string, e_date date")
    kept = lg.dedup_keep_first(df, ["hosp_id", "pat_name", "e_date"])
    assert [r[0] for r in rows_of(kept, "ingest_id")] == [1, 3, 4]
    dup = q.duplicate_rows(df, ["hosp_id", "pat_name"], "e_date")
    assert [r[0] for r in rows_of(dup, "ingest_id")] == [2, 5]
    assert q.duplicate_rows(kept, ["hosp_id", "pat_name"], "e_date").count() == 0


@pytest.mark.parametrize("hot_rows", HOT)
def test_ordinal_and_latest(spark, hot_rows):
    dates = ["2020-03-01", None, "2020-01-01", "2020-01-01"]
    death = ["2020-02-10", None, None, None]
    data = [(i, 1, day(a), day(b)) for i, (a, b) in enumerate(zip(dates, death))]
    df = spark.createDataFrame(data, "ingest_id long, hosp_id long, e_date date, death_date date")
    out = lg.ordinal(df, "hosp_id", "e_date", hot_rows=hot_rows)
    assert [r[0] for r in rows_of(out, "record_count")] == [3, 4, 1, 2]
    latest = lg.group_max(df, "hosp_id", "e_date", "latest", hot_rows=hot_rows)
    latest = frames.override_if_present(latest, "latest", "death_date")
    assert [r[0] for r in rows_of(latest, "latest")] == [day("2020-02-10")] + [day("2020-03-01")] * 3


GAP = [
    (1, 1, "Initial", "2020-01-01", None),
    (2, 1, "Return", "2020-01-05", 90.0),
    (3, 2, "Return", "2020-01-01", 80.0),
    (4, 2, "Initial", "2020-01-04", None),
    (5, 2, "Return", "2020-02-01", 200.0),
    (6, 3, "Return", "2020-01-01", 80.0),
    (7, 3, "Initial", "2020-01-08", None),
    (8, 3, "Return", "2020-02-01", 70.0),
    (9, 4, "Initial", "2020-01-01", 177.0),
]


@pytest.mark.parametrize("hot_rows", HOT)
def test_gap_limited_fill(spark, hot_rows):
    data = [(i, k, t, day(e), v) for i, k, t, e, v in GAP]
    df = spark.createDataFrame(data, "ingest_id long, hosp_id long, encounter_type string, e_date date, v double")

    def fill(intent):
        out = lg.gap_limited_lead_fill(
            df, "hosp_id", "e_date", "v", "encounter_type", "Initial", 7, "filled", intent=intent, hot_rows=hot_rows
        )
        return [r[0] for r in rows_of(out, "filled")]

    assert fill(False) == [None, 90.0, 80.0, 200.0, 200.0, 80.0, None, 70.0, 177.0]
    assert fill(True) == [90.0, 90.0, 80.0, None, 200.0, 80.0, None, 70.0, 177.0]


@pytest.mark.parametrize("hot_rows", HOT)
def test_first_returns(spark, hot_rows):
    data = [
        (1, 1, "Initial", "2020-01-01", None),
        (2, 1, "Return", "2020-01-02", None),
        (3, 1, "Return", "2020-01-03", 5.0),
        (4, 1, "Return", "2020-01-04", 6.0),
        (5, 2, "Initial", "2020-01-01", None),
        (6, 2, "Return", "2020-01-02", None),
        (7, 2, "Return", "2020-01-03", None),
        (8, 2, "Return", "2020-01-04", 9.0),
    ]
    df = spark.createDataFrame(
        [(i, k, t, day(e), v) for i, k, t, e, v in data],
        "ingest_id long, hosp_id long, encounter_type string, e_date date, v double",
    )
    out = lg.fill_from_first_returns(
        df, "hosp_id", "e_date", "v", "encounter_type", "Initial", "Return", 2, "f", hot_rows=hot_rows
    )
    assert [r[0] for r in rows_of(out, "f")] == [5.0, None, 5.0, 6.0, None, None, None, 9.0]


@pytest.mark.parametrize("hot_rows", [3, 7, 40])
def test_hot_keys_change_no_result(spark, hot_rows):
    """One key with a third of all rows, missing keys and dates, cut into small blocks."""
    rows = enc(spark, SF).withColumn(
        "hosp_id",
        F.expr("CASE WHEN ingest_id % 3 = 0 THEN 1 WHEN ingest_id % 7 = 0 THEN NULL ELSE hosp_id END"),
    )
    rows = rows.select("ingest_id", "hosp_id", "pat_name", "e_date", "dx_date", "encounter_type", "creatinine_raw").cache()

    def all_results(n):
        gap = ("hosp_id", "e_date", "creatinine_raw", "encounter_type", "Initial", 7, "out")
        return [
            lg.fill_from_group_min(rows, "hosp_id", "dx_date", "e_date", hot_rows=n),
            lg.harmonise_to_min(rows, "hosp_id", "dx_date", hot_rows=n),
            lg.group_max(rows, "hosp_id", "e_date", "latest", hot_rows=n),
            lg.group_count(rows, "hosp_id", "n", hot_rows=n),
            lg.ordinal(rows, "hosp_id", "e_date", hot_rows=n),
            lg.gap_limited_lead_fill(rows, *gap, hot_rows=n),
            lg.gap_limited_lead_fill(rows, *gap, intent=True, hot_rows=n),
            lg.fill_from_first_returns(
                rows, "hosp_id", "e_date", "creatinine_raw", "encounter_type", "Initial", "Return", 4, "f", hot_rows=n
            ),
        ]

    for plain, split in zip(all_results(10**9), all_results(hot_rows), strict=True):
        assert plain.columns == split.columns
        assert rows_of(plain, "*") == rows_of(split, "*")


def test_fills_never_add_missing(spark):
    rows = enc(spark, SF)
    before = {r["column"]: r.n_missing for r in q.missing_counts(rows, ["iv_date", "dx_date"]).collect()}
    for target, source in (("iv_date", "e_date"), ("dx_date", None)):
        filled = lg.fill_from_group_min(rows, "hosp_id", target, source)
        after = q.missing_counts(filled, [target]).first().n_missing
        assert after <= before[target]


def test_dedup_is_idempotent(spark):
    keys = ["hosp_id", "pat_name", "e_date"]
    once = lg.dedup_keep_first(enc(spark, SF).select("ingest_id", *keys), keys)
    twice = lg.dedup_keep_first(once, keys)
    assert rows_of(once, "*") == rows_of(twice, "*")


def test_drop_strict(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert frames.drop_strict(df, ["a", "c", "a"]).columns == ["b"]
    with pytest.raises(ValueError, match="nope"):
        frames.drop_strict(df, ["a", "nope"])


def test_reorder_and_filters(spark):
    df = spark.createDataFrame([(1, 2, None), (4, 5, "x")], "a int, b int, c string")
    assert frames.reorder(df, ["c", "a", "c"]).columns == ["c", "a", "b"]
    assert frames.keep_label(df, "c", "x").count() == 1
    assert frames.cohort(df, "a", 1, 4).count() == 2
    assert q.negative_duration(df.withColumn("d", F.col("a") - 2), "d").count() == 1


def test_missing_rows_and_label_repeats(spark):
    df = spark.createDataFrame(
        [(1, 1, "A", "Initial", None), (2, 1, "A", "Initial", 5), (3, 1, "A", None, None), (4, 1, "A", "Return", 1), (5, 1, "A", "Return", 1)],
        "ingest_id long, hosp_id long, pat_name string, encounter_type string, v int",
    )
    found = sorted(tuple(r) for r in q.missing_rows(df, ["v", "encounter_type"]).collect())
    assert found == [("encounter_type", 3), ("v", 1), ("v", 3)]
    repeats = q.repeated_label(df, ["hosp_id", "pat_name"], "encounter_type", "Initial")
    assert [r.ingest_id for r in repeats.collect()] == [2]


def test_sort_puts_missing_last(spark):
    start = date(2020, 1, 1)
    df = spark.createDataFrame(
        [(1, None, start), (2, 5, None), (3, 5, start + timedelta(1)), (4, 5, start), (5, 5, start)],
        "ingest_id long, hosp_id long, e_date date",
    )
    out = [r.ingest_id for r in frames.sort_longitudinal(df, ["hosp_id", "e_date"]).collect()]
    assert out == [4, 5, 3, 2, 1]


def test_hot_keys_are_counted_once(spark, monkeypatch):
    calls = []
    counted = skew.hot_keys
    for module in (skew, lg):
        monkeypatch.setattr(module, "hot_keys", lambda *a: calls.append(a) or counted(*a))
    df = spark.createDataFrame([(1, date(2020, 1, 1), 0), (1, None, 1)], "hosp_id int, e_date date, ingest_id long")
    hot = counted(df, ["hosp_id"])
    assert hot is skew.NONE_HOT
    assert lg.ordinal(df, "hosp_id", "e_date", hot=hot).count() == 2 and calls == []
    lg.ordinal(df, "hosp_id", "e_date")
    assert len(calls) == 1


def test_table_of_corrections(spark):
    """50,000 corrections as a mapping, as a small table and as one that is joined by key."""
    df = spark.range(120_000).selectExpr(
        "id AS ingest_id", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 2 = 0 THEN 4 ELSE id END AS hosp_id", "CAST(id AS DOUBLE) AS v", "'x' AS _key"
    )
    fix = {k: -float(k) for k in range(0, 150_000, 3)} | {4: None}
    table = spark.createDataFrame([*fix.items(), (None, 7.0)], "hosp_id long, corrected double")
    assert len(fix) > 50_000

    def plain(i, intent):
        key = None if i % 11 == 0 else 4 if i % 2 == 0 else i
        if key is None:
            return float(i) if intent else None
        return fix.get(key, float(i))

    for intent in (False, True):
        want = [(i, plain(i, intent)) for i in range(120_000)]
        for corrections, most in ((fix, 10**6), (table, 10**6), (table, 10)):
            out = frames.apply_corrections(df, "hosp_id", "v", corrections, intent, most)
            assert out.columns == df.columns and rows_of(out, "ingest_id", "v") == want
    plan = frames.apply_corrections(df, "hosp_id", "v", table)._jdf.queryExecution().toString()
    assert len(plan) < 20_000
    with pytest.raises(ValueError, match="several"):
        frames.apply_corrections(df, "hosp_id", "v", table.union(table))
    assert rows_of(frames.apply_corrections(df, "hosp_id", "v", table.limit(0)), "v") == rows_of(df, "v")


CHAIN = [
    chain.FillMin("iv_date", "e_date"),
    chain.FillMin("dx_date"),
    chain.GroupMax("e_date", "latest"),
    chain.GroupCount("n"),
    chain.HarmoniseMin("dx_date"),
    chain.Ordinal("record_count"),
    chain.LeadFill("creatinine_raw", "encounter_type", "Initial", 7, "seven"),
    chain.LeadFill("creatinine_raw", "encounter_type", "Initial", 14, "fourteen", intent=True),
]


@pytest.mark.parametrize("hot_rows", [10**9, 40, 3])
def test_chain_equals_its_steps(spark, hot_rows):
    key = F.expr("CASE WHEN ingest_id % 3 = 0 THEN 1 WHEN ingest_id % 7 = 0 THEN NULL ELSE hosp_id END")
    rows = enc(spark, SF).withColumn("hosp_id", key)
    rows = rows.select("ingest_id", "hosp_id", "e_date", "iv_date", "dx_date", "encounter_type", "creatinine_raw").cache()
    out = chain.repair_chain(rows, "hosp_id", "e_date", CHAIN, hot_rows=hot_rows)
    step = lg.fill_from_group_min(rows, "hosp_id", "iv_date", "e_date")
    step = lg.fill_from_group_min(step, "hosp_id", "dx_date")
    step = lg.group_max(step, "hosp_id", "e_date", "latest")
    step = lg.group_count(step, "hosp_id", "n")
    step = lg.harmonise_to_min(step, "hosp_id", "dx_date")
    step = lg.ordinal(step, "hosp_id", "e_date")
    gap = ("hosp_id", "e_date", "creatinine_raw", "encounter_type", "Initial")
    step = lg.gap_limited_lead_fill(step, *gap, 7, "seven")
    step = lg.gap_limited_lead_fill(step, *gap, 14, "fourteen", intent=True)
    assert out.columns == step.columns and rows_of(out, "*") == rows_of(step, "*")


def test_chain_is_one_exchange_and_one_scan(spark):
    rows = enc(spark, SF).select("ingest_id", "hosp_id", "e_date", "iv_date", "dx_date", "encounter_type", "creatinine_raw")
    out = chain.repair_chain(rows, "hosp_id", "e_date", CHAIN)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(hosp_id") == 1 and plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert [len(r) for r in chain.rounds(CHAIN[:5])] == [4, 1]
    with pytest.raises(ValueError, match="come after"):
        chain.repair_chain(rows, "hosp_id", "e_date", [CHAIN[5], CHAIN[0]])
    with pytest.raises(ValueError, match="another"):
        chain.repair_chain(rows, "hosp_id", "e_date", [CHAIN[6], chain.LeadFill("seven", "encounter_type", "Initial", 7, "x")])


def test_chunks_of_sparse_row_ids(spark):
    """Row ids as Spark hands them out, with gaps of 2^33: chunks follow the rows, not the ids."""
    rows = spark.range(0, 4_000, numPartitions=7).select(
        F.expr("CASE WHEN id % 5 = 0 THEN id ELSE -1 END").alias("k"), F.expr("CASE WHEN id % 4 > 0 THEN DATE'2020-01-01' END").alias("d"),
        F.col("id").alias("v"), F.monotonically_increasing_id().alias("row_id"),
    ).cache()
    hot = skew.hot_keys(rows, ["k"], 100)
    chunks = skew._with_blocks(skew.split_hot(rows, ["k"], hot)[1], "k", "d", "row_id", 100).groupBy("k", "d", "_block").count().collect()
    assert max(r["count"] for r in chunks) <= 200 and len(chunks) <= 2 * 3_200 / 100
    plain = skew.with_neighbours(rows, "k", "d", "row_id", ["v"], skew.NONE_HOT)
    split = skew.with_neighbours(rows, "k", "d", "row_id", ["v"], hot, 100)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
