from __future__ import annotations

from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kinpanel.operators import population as p
from kinpanel.plans.cohort import Study, build_population
from kinpanel.sources.registers import read_births, read_population

BEF = [
    ("1", "F1", "M1", "FAM1", "2010-01-01"),
    ("2", "F2", "M2", "FAM2", "2011-02-02"),
    ("3", "F2", "M2", "FAM2", "2011-02-02"),
    ("4", "F4", "M4", "FAM4", "2012-03-03"),
    ("5", "F5", "M5", "FAM5", "2013-04-04"),
]
MFR = [
    ("3", "F3", "M3", "2011-02-02"),
    ("4", "F4", "M4", "2012-03-03"),
    ("5", "F5", "M5", "2013-04-04"),
    ("6", "F6", "M6", "2012-05-05"),
    ("7", "F7", "M7", "2013-06-06"),
]
BEF_COLUMNS = "PNR string, FAR_ID string, MOR_ID string, FAMILIE_ID string, FOED_DAG string"
MFR_COLUMNS = "CPR_BARN string, CPR_FADER string, CPR_MODER string, FOEDSELSDATO string"


def write(spark, folder, bef=BEF, mfr=MFR, drop=None):
    b = spark.createDataFrame(bef, BEF_COLUMNS)
    m = spark.createDataFrame(mfr, MFR_COLUMNS)
    if drop:
        b, m = b.drop(drop), m.drop(drop)
    b.coalesce(1).write.mode("overwrite").parquet(f"{folder}/bef")
    m.coalesce(1).write.mode("overwrite").parquet(f"{folder}/mfr")
    return Study({"bef": f"{folder}/bef", "mfr": f"{folder}/mfr"}, f"{folder}/out", 2010, 2013)


def test_population_of_both_registers(spark, folder):
    result = build_population(spark, write(spark, folder))
    assert result.columns == p.FAMILY
    assert dict(result.dtypes)["FOED_DAG"] == "date"
    rows = {r["PNR"]: r for r in result.collect()}
    assert sorted(rows) == list("1234567")
    assert [rows[k]["FAMILIE_ID"] for k in "345"] == ["FAM2", "FAM4", "FAM5"]
    assert rows["3"]["FAR_ID"] == "F2"
    assert rows["6"]["FAMILIE_ID"] is None and rows["7"]["FAR_ID"] == "F7"
    assert rows["6"]["FOED_DAG"] == date(2012, 5, 5)
    before = spark.read.parquet(f"{folder}/out/population_summary_before").first()
    after = spark.read.parquet(f"{folder}/out/population_summary_after").first()
    assert (before["total_bef_records"], before["total_mfr_records"]) == (5, 5)
    assert before["bef_missing_far"] == 0
    assert after.asDict() == {
        "total_combined_records": 7,
        "combined_missing_far": 0,
        "combined_missing_mor": 0,
        "records_only_in_bef": 2,
        "records_only_in_mfr": 2,
        "records_with_family_id": 5,
    }


def test_without_birth_register(spark, folder):
    study = write(spark, folder)
    study.registers["mfr"] = f"{folder}/nothing/*.parquet"
    assert build_population(spark, study).count() == 5
    assert read_births(spark, f"{folder}/nothing") is None
    before = spark.read.parquet(f"{folder}/out/population_summary_before")
    assert before.columns == ["total_bef_records", "bef_missing_far", "bef_missing_mor"]


@pytest.mark.parametrize("column", ["PNR", "FAR_ID", "MOR_ID", "FAMILIE_ID", "FOED_DAG", "CPR_BARN", "CPR_FADER", "CPR_MODER", "FOEDSELSDATO"])
def test_missing_columns_are_an_error(spark, folder, column):
    study = write(spark, folder, drop=column)
    with pytest.raises((ValueError, AnalysisException)):
        build_population(spark, study)


def test_empty_registers(spark, folder):
    assert build_population(spark, write(spark, folder, [], [])).count() == 0


def test_first_record_is_the_earliest(spark):
    rows = [("a", 2001, 5, "late"), ("a", 2000, 12, "y"), ("a", 2000, 12, "x"), ("b", None, None, "no period"), ("b", 1999, 1, "z")]
    df = spark.createDataFrame(rows, "PNR string, year int, month int, v string")
    got = {r["PNR"]: r["v"] for r in p.first_record(df, "PNR", ["PNR", "v"], ["year", "month"]).collect()}
    assert got == {"a": "x", "b": "no period"}


def test_parents_found_by_id(spark):
    children = spark.createDataFrame(
        [("c", date(2010, 1, 1), "f", None, "F"), ("d", date(2011, 1, 1), "unknown", "m", None)],
        "PNR string, FOED_DAG date, FAR_ID string, MOR_ID string, FAMILIE_ID string",
    )
    parents = spark.createDataFrame([("f", date(1980, 1, 1)), ("m", date(1982, 2, 2))], "PNR string, FOED_DAG date")
    got = {r["PNR"]: (r["FAR_FDAG"], r["MOR_FDAG"]) for r in p.add_parent_births(children, parents).collect()}
    assert got == {"c": (date(1980, 1, 1), None), "d": (None, date(1982, 2, 2))}


def test_very_many_children_of_one_parent(spark):
    children = spark.range(500).select(
        F.col("id").cast("string").alias("PNR"),
        F.lit("2010-01-01").cast("date").alias("FOED_DAG"),
        F.when(F.col("id") % 3 == 0, "f").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("FAR_ID"),
        F.lit("m").alias("MOR_ID"),
        F.lit(None).cast("string").alias("FAMILIE_ID"),
    )
    parents = spark.createDataFrame([("f", date(1980, 1, 1)), ("m", date(1982, 2, 2))], "PNR string, FOED_DAG date")
    got = p.add_parent_births(children, parents, hot_rows=20)
    assert got.count() == 500
    assert got.where("FAR_FDAG is not null").count() == 167
    assert got.where("MOR_FDAG = date'1982-02-02'").count() == 500


def test_population_register_dates_and_period(spark, folder):
    df = spark.createDataFrame([("1", "F", "M", "FAM", "15May2010")], BEF_COLUMNS)
    df.coalesce(1).write.parquet(f"{folder}/x")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{folder}/x/*.parquet")[0], f"{folder}/bef_201012.parquet")
    row = read_population(spark, f"{folder}/bef_*.parquet").first()
    assert (row["FOED_DAG"], row["year"], row["month"]) == (date(2010, 5, 15), 2010, 12)
