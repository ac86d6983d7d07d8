from __future__ import annotations

import glob
import json
import os
import shutil

import pytest

from kinpanel.sources import dictionaries as d
from kinpanel.sources import manifest as m
from kinpanel.sources import registers as r
from kinpanel.sources import tables as t


def one_file(df, folder, name):
    """Write a table as one named parquet file."""
    tmp = f"{folder}/tmp-{name}"
    df.coalesce(1).write.parquet(tmp)
    os.makedirs(f"{folder}/in", exist_ok=True)
    shutil.copy(glob.glob(f"{tmp}/*.parquet")[0], f"{folder}/in/{name}")
    return f"{folder}/in"


def test_round_trip(spark, folder):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "col1 string, col2 bigint")
    t.write_table(df, f"{folder}/x")
    back = r.read_parquet(spark, f"{folder}/x")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert any("snappy" in f for f in os.listdir(f"{folder}/x"))


def test_yearly_files_with_missing_columns(spark, folder):
    one_file(spark.createDataFrame([("1", 5)], "PNR string, KOM int"), folder, "bef_2001.parquet")
    one_file(spark.createDataFrame([("2", 6, "v")], "PNR string, KOM int, VERSION string"), folder, "bef_200212.parquet")
    path = one_file(spark.createDataFrame([("3", "K")], "PNR string, KOEN string"), folder, "bef.parquet")
    got = r.read_register(spark, "bef", path)
    assert dict(got.dtypes) == {"KOM": "smallint", "PNR": "string", "KOEN": "string", "year": "int", "month": "int"}
    assert {tuple(x) for x in got.select("PNR", "KOM", "KOEN", "year", "month").collect()} == {
        ("1", 5, None, 2001, None), ("2", 6, None, 2002, 12), ("3", None, "K", None, None),
    }
    kept = r.read_register(spark, "bef", path, keep=["PNR", "ABSENT"], ordered=True)
    assert kept.columns == ["PNR", "year", "month"]
    assert [x["PNR"] for x in kept.collect()] == ["3", "1", "2"]
    with pytest.raises(ValueError):
        r.read_register(spark, "bef", path, keep=["PNR"], drop=["KOM"])


def test_period_of_a_folder_written_by_spark(spark, folder):
    spark.createDataFrame([("1",)], "PNR string").write.parquet(f"{folder}/akm2007.parquet")
    spark.createDataFrame([("2",)], "PNR string").write.parquet(f"{folder}/akm_200811.parquet")
    got = r.read_register(spark, "akm", f"{folder}/akm*.parquet")
    assert {tuple(x) for x in got.collect()} == {("1", 2007, None), ("2", 2008, 11)}


def test_scan_reads_only_needed_columns(spark, folder):
    path = one_file(spark.createDataFrame([("1", 5, "x")], "PNR string, KOM int, KOEN string"), folder, "bef_2001.parquet")
    plan = r.read_register(spark, "bef", path).where("KOM > 3").select("PNR")._jdf.queryExecution().executedPlan().toString()
    assert "KOEN" not in plan and "PushedFilters" in plan


@pytest.fixture
def panel(spark):
    return spark.range(300).selectExpr("cast(id as string) PNR", "cast(2000 + id % 3 * 2 as int) year", "id v")


def test_panel_by_year(spark, folder, panel):
    path = f"{folder}/p"
    t.write_panel(panel, path, rows_per_file=40)
    assert sorted(x for x in os.listdir(path) if x.startswith("year")) == ["year=2000", "year=2002", "year=2004"]
    files = glob.glob(f"{path}/year=2000/*.parquet")
    assert len(files) >= 3 and all(".zstd." in f for f in files)
    got = t.read_panel(spark, path, 2001, 2002)
    assert got.count() == 100
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().executedPlan().toString()
    assert t.read_panel(spark, path).count() == 300
    one = spark.read.parquet(files[0])
    assert [x[0] for x in one.select("PNR").collect()] == sorted(x[0] for x in one.select("PNR").collect())
    assert [x[0] for x in t.check_partitions(spark, path).orderBy("year").collect()] == [2001, 2003]
    rows = {x["year"]: x["files"] for x in t.partition_rows(spark, path).collect()}
    assert rows["2000"] == len(files)


def test_partitions_must_exist(spark, folder, panel):
    t.write_table(panel, f"{folder}/flat")
    with pytest.raises(ValueError):
        t.check_partitions(spark, f"{folder}/flat")
    t.write_table(panel, f"{folder}/by", partition_by="year")
    assert spark.read.parquet(f"{folder}/by").count() == 300


def test_csv_reports(spark, folder, panel):
    t.write_report(panel.groupBy("year").count(), f"{folder}/r")
    assert len(glob.glob(f"{folder}/r/*.csv")) == 1
    assert spark.read.csv(f"{folder}/r", header=True).columns == ["year", "count"]
    t.write_listing(panel, f"{folder}/l")
    assert spark.read.csv(f"{folder}/l", header=True).count() == 300


def test_dictionaries(spark, folder):
    with open(f"{folder}/reg.json", "w", encoding="utf-8") as f:
        json.dump({"81": "Nordjylland", "85": "Sjælland"}, f, indent=2)
    assert {tuple(x) for x in d.read_json_dictionary(spark, f"{folder}/reg.json").collect()} == {("81", "Nordjylland"), ("85", "Sjælland")}
    levels = d.read_education_levels(spark, f"{folder}/reg.json", f"{folder}/levels")
    assert levels.columns == ["HFAUDD", "EDU_LVL"] and levels.count() == 2
    with open(f"{folder}/reg.json", "w", encoding="utf-8") as f:
        json.dump({"1": "x"}, f)
    assert d.read_education_levels(spark, f"{folder}/reg.json", f"{folder}/levels").count() == 2
    assert d.read_education_levels(spark, f"{folder}/reg.json").count() == 1
    with open(f"{folder}/icd.csv", "w") as f:
        f.write("icd10,description\nA001,\"Cholera, one\"\n")
    assert tuple(d.read_icd_texts(spark, f"{folder}/icd.csv").first()) == ("A001", "Cholera, one")


@pytest.mark.parametrize("fingerprint", ["stamp", "rows"])
def test_unchanged_inputs_are_skipped(spark, folder, fingerprint):
    path = one_file(spark.createDataFrame([("1",), ("1",)], "PNR string"), folder, "a.parquet")
    runs = []
    job = lambda: runs.append(1)
    args = (spark, "bef", path, f"{folder}/manifest", job, fingerprint)
    assert m.run_if_changed(*args) is True
    assert m.run_if_changed(*args) is False
    one_file(spark.createDataFrame([("2",)], "PNR string"), folder, "b.parquet")
    spark.catalog.clearCache()
    assert m.run_if_changed(*args) is True
    current = m.file_manifest(spark, "bef", path, fingerprint)
    assert current.count() == 2
    assert m.changed_files(current, None).count() == 2
    stored = m.read_manifest(spark, f"{folder}/manifest/done/bef")
    assert m.changed_files(current, stored).count() == 0
    assert m.changed_files(current, stored.where("path like '%a.parquet'")).count() == 1
    assert m.removed_files(current.where("false"), stored).count() == 2
    assert len(runs) == 2


def test_failed_jobs_run_again(spark, folder):
    path = one_file(spark.createDataFrame([("1",)], "PNR string"), folder, "a.parquet")

    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        m.run_if_changed(spark, "bef", path, f"{folder}/manifest", fail)
    assert m.run_if_changed(spark, "bef", path, f"{folder}/manifest", lambda: None) is True


def test_unknown_fingerprint(spark, folder):
    path = one_file(spark.createDataFrame([("1",)], "PNR string"), folder, "a.parquet")
    with pytest.raises(ValueError):
        m.file_manifest(spark, "bef", path, "other")


def test_catalogue(spark, folder):
    m.write_catalogue(m.catalogue(spark), f"{folder}/c")
    got = spark.read.json(f"{folder}/c")
    assert got.where("kind = 'zone'").count() == 4 and got.where("kind = 'domain'").count() == 5
    assert got.where("created_at is null").count() == 0


def test_files_whose_integer_widths_differ(spark, folder):
    """One yearly file has the column in a byte, the next in a short."""
    from kinpanel.sources.registers import read_register

    for year, kind in ((2001, "tinyint"), (2002, "smallint")):
        spark.sql(f"SELECT '1' AS PNR, CAST({year - 1900} AS {kind}) AS KOM").write.parquet(f"{folder}/bef{year}12.parquet")
    df = read_register(spark, "bef", f"{folder}/bef*.parquet")
    assert sorted((r["year"], r["KOM"]) for r in df.collect()) == [(2001, 101), (2002, 102)]
    assert dict(df.dtypes)["KOM"] == "smallint"
