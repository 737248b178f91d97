"""CSV files in, the whole registry configuration, tables out."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortline.operators import cox, survival as sv
from cohortline.plans import bindings as b, clinical as cl, dictionaries as d
from cohortline.sources import encounters as src

SF = "/root/testdata/sf0.001"
COLUMNS = [*d.RENAME, *d.DROPPED]


def write_csv(path, rows):
    lines = [",".join(COLUMNS)]
    for row in rows:
        lines.append(",".join(str(row.get(c, "NA")) for c in COLUMNS))
    path.write_text("\n".join(lines) + "\n")


def encounter(hosp, e_date, kind="Return", **more):
    return {
        "Hosp_ID": hosp, "Pat_Name": f"P{hosp}", "E_Date": e_date, "Encounter_Type": kind,
        "Date_diagnosis": "1/15/2021", "Year_of_birth": 1960, "Survival": "Alive", **more,
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("encounters")
    write_csv(
        path / "a.csv",
        [
            encounter(1, "2/1/2021", "Initial", Chemo_Regimen="15", ManagementPlan_Notes="on TD", chief_complaint="1;3"),
            encounter(1, "2/1/2021", "Return"),
            encounter(1, " 2/4/2021 10:00 ", "Return", **{"Serum_creatinine_mmol/l": " 200 ", "HgB_g/dl": 9.5}),
            encounter(2, "3/1/2021", "Return", Date_diagnosis="", Survival="DECEASED"),
            encounter(2, "3/4/2021", "Initial", Date_diagnosis="3/1/2021", Survival="deceased", ManagementPlan_Notes="on TD then on VTD"),
            encounter(2, "3/9/2021", "NA", Date_diagnosis="", OnRemission="FALSE", **{"Serum_creatinine_mmol/l": 150, "Death Date": "5/1/2021"}),
        ],
    )
    write_csv(path / "b.csv", [encounter(3, "2/30/2020", "Initial", Date_diagnosis="1/1/2019"), encounter(3, "zz")])
    return path


@pytest.fixture(scope="module")
def raw(spark, folder):
    return cl.read_registry(spark, str(folder), COLUMNS)


def test_ingest(raw):
    rows = raw.orderBy("ingest_id").collect()
    assert [r.ingest_id for r in rows] == list(range(8))
    assert [r.hosp_id for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3]
    assert rows[2].e_date == date(2021, 2, 4) and rows[2].creatinine_raw == 200.0
    assert rows[3].dx_date is None and rows[5].encounter_type is None and rows[5].on_remission is False
    assert rows[6].e_date is None and rows[7].e_date is None


def test_numbering_survives_small_splits(spark, tmp_path):
    for name, start in (("x.csv", 0), ("y.csv", 3000)):
        lines = ["k,v"] + [f"{i},{'t' * (i % 9)}" for i in range(start, start + 3000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = src.read_encounters(spark, str(tmp_path), ["k", "v"], {"k": "key"}, {"key": "bigint"})
        assert df.count() == 6000
        assert df.filter("ingest_id <> key").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_registry_end_to_end(raw):
    derived = cl.registry(raw, drop=[*d.DROPPED, "birth_year"])
    rows = {r.ingest_id: r for r in derived.collect()}
    assert sorted(rows) == [0, 2, 3, 4, 5]  # one duplicate day, one patient outside the cohort
    assert derived.columns[:4] == ["iv_date", "hosp_id", "dx_date", "e_date"]
    first, second = rows[0], rows[4]
    assert (first.treatment, first.complaint) == ("Others", "Bone Pain;Fatigue")
    assert (first.bone_pain, first.fatigue, first.nausea) == ("Yes", "Yes", "No")
    assert first.creatinine is None  # no row before it
    assert (second.creatinine, second.treatment, second.renal_failure) == (150.0, "TD", "<=177")
    assert (second.dx_date, second.iv_date) == (date(2021, 3, 1), date(2021, 3, 1))
    assert (second.latest_encounter, rows[5].latest_encounter) == (date(2021, 3, 9), date(2021, 5, 1))
    assert (first.survival_status, second.survival_status, rows[2].anemia) == (0, 1, "< 10")
    assert (rows[2].renal_failure, first.age, rows[5].encounter_type) == ("> 177", 61, "Return")
    initial = cl.initial_visits(derived).orderBy("ingest_id").collect()
    assert [(r.survival_days, r.survival_months) for r in initial] == [(20.0, 0.7), (8.0, 0.3)]


def test_missing_column_to_drop_is_an_error(spark, raw):
    filled = cl.fill_dates(raw.drop("Vitals"))
    with pytest.raises(ValueError, match="Vitals"):
        cl.clean(filled, drop=d.DROPPED)


def test_write_review_and_snapshot(spark, raw, tmp_path):
    review = cl.diagnosis_conflicts(raw)
    src.write_review(review, str(tmp_path / "review"))
    back = spark.read.option("header", True).csv(str(tmp_path / "review"))
    assert sorted(r.hosp_id for r in back.collect()) == ["2", "3"]
    src.write_snapshot(raw, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 8
    src.write_snapshot(raw.select("ingest_id", "e_date"), str(tmp_path / "csv"), "csv")
    text = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert text.filter(F.col("e_date") == "NA").count() == 2


def test_intent_differs_only_where_it_should(spark):
    rows = b.registry_rows(spark, SF)
    clean = cl.clean(cl.fill_dates(rows, b.REGISTRY_CORRECTIONS), b.REGISTRY_COHORT)
    literal, intent = cl.derive(clean), cl.derive(clean, intent=True)
    pairs = zip(literal.orderBy("ingest_id").collect(), intent.orderBy("ingest_id").collect(), strict=True)
    changed = {c for a, b in pairs for c in literal.columns if a[c] != b[c]}
    assert changed <= {
        "creatinine", "spep", "renal_failure", "complaint", "pain_site", "signs", "no_pain_site", "remission_plan",
        "on_remission", *d.COMPLAINT_FLAGS, *d.PAIN_FLAGS, *d.SIGN_FLAGS,
    }
    assert {"on_remission", "no_pain_site"} <= changed
    once = cl.initial_visits(intent, intent=True)
    assert once.count() == once.select("hosp_id").distinct().count()


def test_hot_patient_changes_no_result(spark):
    """One patient with a third of the rows, cut at seven rows per block."""
    rows = b.registry_rows(spark, SF).withColumn(
        "hosp_id", F.expr("CASE WHEN ingest_id % 3 = 0 THEN 5 ELSE hosp_id END")
    )
    plain = cl.registry(rows, b.REGISTRY_CORRECTIONS, b.REGISTRY_COHORT)
    split = cl.registry(rows, b.REGISTRY_CORRECTIONS, b.REGISTRY_COHORT, hot_rows=7)
    assert plain.count() > 500
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_models(spark):
    initial = cl.initial_visits(cl.registry(b.registry_rows(spark, SF), b.REGISTRY_CORRECTIONS, b.REGISTRY_COHORT))
    fits = cl.cox_models(initial, ["anemia", "creatinine"])
    table = cox.cox_table(fits).collect()
    assert [r.model for r in table] == ["anemia", "creatinine"]
    assert table[0].term == "anemia=>=10"
    km = cl.survival_curve(initial)
    assert sv.km_at(km, [d.REPORT_MONTHS]).count() <= 1


def test_quoted_cells_survive(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('k,notes,z\n1,"line one\nline two",a\n2,"says ""on TD, now"" ok",b\n3,"",c\n4,NA," d "\n')
    got = [tuple(r) for r in src.read_encounters(spark, str(path), ["k", "notes", "z"], {}).orderBy("ingest_id").collect()]
    assert got == [(0, "1", "line one\nline two", "a"), (1, "2", 'says "on TD, now" ok', "b"), (2, "3", None, "c"), (3, "4", None, "d")]


def test_malformed_record_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("k,z\n1,a\n2,b,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_encounters(spark, str(path), ["k", "z"], {}).collect()


def test_first_visits_of_a_missing_key(spark):
    rows = [(None, 2, "Initial"), (None, 1, "Initial"), (7, 1, "Initial"), (7, 2, "Initial"), (8, 1, "Return")]
    df = spark.createDataFrame(rows, "hosp_id long, record_count int, encounter_type string")
    for name, kind in (("dx_date", "date"), ("latest_encounter", "date"), ("outcome", "string")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    got = cl.initial_visits(df, intent=True).select("hosp_id", "record_count").collect()
    assert sorted(map(tuple, got), key=str) == [(7, 1), (None, 1)]
