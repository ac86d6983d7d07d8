from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from kinpanel.operators import health as h


@pytest.fixture
def v2(spark):
    contacts = spark.createDataFrame(
        [("1", "DE750", "R1", date(2010, 1, 1)), ("2", "DZ000", "R2", date(2010, 1, 2)), ("3", "DE760", "R3", date(2010, 1, 3))],
        "PNR string, C_ADIAG string, RECNUM string, D_INDDTO date",
    )
    diagnoses = spark.createDataFrame(
        [("R1", "DE750", "DZ000"), ("R2", "DZ000", "DZ000"), ("R3", "DE760", "DE750")], "RECNUM string, C_DIAG string, C_TILDIAG string"
    )
    visits = spark.createDataFrame([(f"R{i}", date(2010, 1, i)) for i in (1, 2, 3)], "RECNUM string, D_AMBDTO date")
    return contacts, diagnoses, visits


@pytest.fixture
def v3(spark):
    contacts = spark.createDataFrame(
        [("K1", "4", "DE840", date(2020, 1, 1)), ("K2", "5", "DZ000", date(2020, 1, 2)), ("K3", "6", "DE840", date(2020, 1, 3))],
        "DW_EK_KONTAKT string, CPR string, aktionsdiagnose string, dato_start date",
    ).withColumn("SORENHED_ANS", F.lit(None).cast("string")).withColumn("dato_slut", F.col("dato_start"))
    diagnoses = spark.createDataFrame([("K1", "DE840"), ("K2", "DZ000"), ("K3", "DE760")], "DW_EK_KONTAKT string, diagnosekode string")
    return contacts, diagnoses


def test_systems_are_integrated(v2, v3):
    a = h.integrate_v2(*v2)
    assert a.count() == 3 and {"PNR", "C_ADIAG", "RECNUM", "D_INDDTO", "C_DIAG", "D_AMBDTO"} <= set(a.columns)
    assert {r[0] for r in a.select("department_code").collect()} == {"Unknown"}
    b = h.integrate_v3(*v3)
    assert b.count() == 3 and {"CPR", "aktionsdiagnose", "dato_start", "diagnosekode"} <= set(b.columns)
    assert {r[0] for r in b.select("department_code").collect()} == {"Unknown"}


def test_combinations_are_kept(spark, v2):
    contacts, diagnoses, visits = v2
    more = diagnoses.union(diagnoses)
    assert h.integrate_v2(contacts, more, visits.union(visits)).count() == 12
    assert h.integrate_v2(contacts, more, visits.union(visits), hot_rows=1).count() == 12


def test_health_data_and_flags(v2, v3):
    health = h.health_data(*v2, *v3)
    assert health.count() == 6
    assert health.columns == sorted(health.columns)
    types = dict(health.dtypes)
    assert {types[c] for c in ("admission_date", "discharge_date", "outpatient_date")} == {"date"}
    assert {(r["source"], r["n"]) for r in health.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("LPR2", 3), ("LPR3", 3)}
    flags = {r["PNR"]: (r["is_scd"], r["first_scd_date"]) for r in h.scd_by_person(health).collect()}
    assert flags == {
        "1": (True, date(2010, 1, 1)), "2": (False, None), "3": (True, date(2010, 1, 3)),
        "4": (True, date(2020, 1, 1)), "5": (False, None), "6": (True, date(2020, 1, 3)),
    }
    h.check_people_kept(health, h.scd_by_person(health), "patient_id", "PNR")
    with pytest.raises(ValueError):
        h.check_people_kept(health, h.scd_by_person(health).where("is_scd"), "patient_id", "PNR")


def test_harmonised_text_dates(spark):
    a = spark.createDataFrame([("1", "A", "2021-01-01"), ("2", "B", "2021-01-02")], "PNR string, C_ADIAG string, D_INDDTO string")
    b = spark.createDataFrame([("3", "C", "01Jan2021"), ("4", "D", "2021/01/02")], "CPR string, aktionsdiagnose string, dato_start string")
    got = h.combine_sources(h.harmonise(a, "LPR2"), h.harmonise(b, "LPR3"))
    assert set(got.columns) == {"patient_id", "primary_diagnosis", "admission_date", "source", "department"}
    assert {tuple(r) for r in got.select("patient_id", "source", "admission_date").collect()} == {
        ("1", "LPR2", date(2021, 1, 1)), ("2", "LPR2", date(2021, 1, 2)), ("3", "LPR3", date(2021, 1, 1)), ("4", "LPR3", date(2021, 1, 2)),
    }


FLAG_COLUMNS = "id string, diag string, date date"


def test_flags_per_patient(spark):
    d = date(2020, 1, 1)
    df = spark.createDataFrame([("1", "DE840", d), ("2", "DZ000", d), ("3", "DE840", date(2020, 1, 3)), ("3", "DE840", d)], FLAG_COLUMNS)
    got = {r["id"]: (r["is_scd"], r["first_scd_date"]) for r in h.flag_patients(df, ["diag"], "date", "id").collect()}
    assert got == {"1": (True, d), "2": (False, None), "3": (True, d)}


def test_flags_of_invalid_and_no_codes(spark):
    df = spark.createDataFrame([("1", "INVALID", None), ("2", "NOT_A_CODE", None), ("3", None, None)], FLAG_COLUMNS)
    assert {tuple(r) for r in h.flag_patients(df, ["diag"], "date", "id").collect()} == {("1", False, None), ("2", False, None), ("3", False, None)}
    assert h.flag_patients(df.where("false"), ["diag"], "date", "id").count() == 0
    with pytest.raises(ValueError):
        h.flag_patients(df, ["missing"], "date", "id")


def test_flags_without_record_join_agree(v2):
    contacts, diagnoses, _ = v2
    direct = h.flag_contacts(contacts, diagnoses, "RECNUM", "PNR", "D_INDDTO", ["C_ADIAG"], ["C_DIAG", "C_TILDIAG"])
    joined = h.flag_patients(h.integrate_v2(*v2), ["C_ADIAG", "C_DIAG", "C_TILDIAG"], "D_INDDTO", "PNR")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, joined.collect()))


def test_population_keeps_people_without_contacts(spark):
    people = spark.createDataFrame([(1,), (2,)], "PNR int")
    flags = spark.createDataFrame([("1", True, date(2020, 1, 1))], "PNR string, is_scd boolean, first_scd_date date")
    out = h.add_flags(people, flags)
    assert {tuple(r) for r in out.collect()} == {("1", True, date(2020, 1, 1)), ("2", False, None)}
    assert {tuple(r) for r in h.prevalence(out).collect()} == {("Total Population", 2.0), ("SCD Cases", 1.0), ("Prevalence (%)", 50.0)}
    assert h.prevalence(out.where("false")).where("metric = 'Prevalence (%)'").first()["value"] == 0.0


HEALTH_COLUMNS = (
    "patient_id string, record_id string, primary_diagnosis string, diagnosis string, secondary_diagnosis string, "
    "admission_date date, discharge_date date, admission_type string, department string"
)


def test_person_year_health(spark):
    d = date(2010, 5, 1)
    rows = [
        ("a", "r1", "DD56", "DD60", None, d, date(2010, 5, 3), "2", "X"),
        ("a", "r1", "DD56", "DQ99", None, d, date(2010, 5, 3), "2", "X"),
        ("a", "r2", "DD56", None, "DJ45", d, None, "1", "Y"),
        ("a", "r3", "DD56", None, None, d, None, "1", "Y"),
        ("a", "r4", None, None, None, d, date(2010, 5, 9), None, "Z"),
        ("a", "r5", None, None, None, None, None, "9", "Z"),
        (None, "r6", None, None, None, d, None, None, "Unknown"),
    ]
    df = spark.createDataFrame(rows, HEALTH_COLUMNS)
    got = {(r["PNR"], r["year"]): r for r in h.person_year_health(df).collect()}
    assert set(got) == {("a", 2010), ("a", None), (None, 2010)}
    a = got["a", 2010]
    # Both types occur twice: the smaller one is named.
    assert a["most_common_admission_type"] == "1"
    assert (a["num_primary_diagnoses"], a["num_diagnoses"], a["num_secondary_diagnoses"], a["num_admissions"]) == (4, 2, 1, 5)
    assert a["last_discharge"] == date(2010, 5, 9) and a["num_unique_departments"] == 3
    assert got["a", None]["num_admissions"] == 0
    assert got[None, 2010]["most_common_admission_type"] is None
    once = {(r["PNR"], r["year"]): r for r in h.person_year_health(df, dedupe=True).collect()}["a", 2010]
    assert (once["num_primary_diagnoses"], once["num_admissions"], once["most_common_admission_type"]) == (3, 4, "1")

    groups = {(r["PNR"], r["year"]): r for r in h.diagnosis_groups(df).collect()}
    assert len(groups["a", 2010]) == 22
    assert groups["a", 2010]["num_blood_disorders_diagnoses"] == 4
    assert groups["a", 2010]["num_congenital_admissions"] == 1
    assert groups["a", None]["num_renal_diagnoses"] == 0
    assert (groups["a", 2010]["num_respiratory_diagnoses"]) == 1


def test_code_texts(spark):
    df = spark.createDataFrame([("DA001", "DB001"), ("DE750", None), ("Z", "DE750")], "C_ADIAG string, C_DIAG string")
    texts = spark.createDataFrame([("A001", "first"), ("E750", "second")], "icd10 string, description string")
    got = h.add_code_text(df, texts)
    assert got.columns == ["C_ADIAG", "C_DIAG", "description", "description_diag"]
    assert {tuple(r) for r in got.collect()} == {("DA001", "DB001", "first", None), ("DE750", None, "second", None), ("Z", "DE750", None, "second")}


def test_flags_of_both_systems(spark):
    """The same flags as from contact summaries; no job is started before they are asked for."""
    from queries.health import _flags_of_both, register

    sf = "/root/testdata/sf0.001"
    names = ("adm", "diag", "bes", "kont", "diag3")
    spark.sparkContext.setJobGroup("flags", "plan")
    tables = {n: register(spark, sf, n) for n in names}
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("flags"))  # reading the files' schemas
    got = h.flags_of_both(*[tables[n] for n in names if n != "bes"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("flags"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == before
    want = h.care_flags(h.care_of_both(*tables.values()))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert _flags_of_both(spark, sf).columns == ["PNR", "is_scd", "first_scd_date"]
