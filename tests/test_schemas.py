"""Readers over files whose columns change type from year to year."""

from __future__ import annotations

import os
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinpanel.sources import schemas as s
from kinpanel.sources.registers import read_births, read_parquet, read_population, read_register
from kinpanel.sources.tables import read_panel

PEOPLE = "'{0}' AS PNR, 'f' AS FAR_ID, 'm' AS MOR_ID, 'x' AS FAMILIE_ID, '2001-02-03' AS FOED_DAG"


def write(spark, path, sql):
    spark.sql(f"SELECT {sql}").write.parquet(path)


def test_numbers_of_other_widths_are_one_scan(spark, folder):
    for year, kind in ((2001, "tinyint"), (2002, "smallint"), (2003, "int"), (2004, "bigint")):
        write(spark, f"{folder}/x{year}.parquet", f"CAST({year - 1950} AS {kind}) AS n, CAST({year} AS {'float' if year < 2003 else 'double'}) AS v")
    frames = s.read_each(spark, f"{folder}/x*.parquet")
    assert len(frames) == 1 and dict(frames[0].dtypes) == {"n": "bigint", "v": "double"}
    assert sorted(map(tuple, frames[0].collect())) == [(y - 1950, float(y)) for y in range(2001, 2005)]


def test_types_with_nothing_in_common(spark, folder):
    write(spark, f"{folder}/x2001.parquet", "1 AS n, 'a' AS t")
    write(spark, f"{folder}/x2002.parquet", "'two' AS n, 'b' AS t")
    write(spark, f"{folder}/x2003.parquet", "CAST(3 AS tinyint) AS n, 'c' AS t, 5 AS more")
    write(spark, f"{folder}/x2004.parquet", "'d' AS t")
    groups = s.type_groups(spark, f"{folder}/x*.parquet")
    assert sorted(len(files) for _, files in groups) == [1, 1, 2]
    df = read_parquet(spark, f"{folder}/x*.parquet")
    assert {tuple(r) for r in df.select("n", "t", "more").collect()} == {("1", "a", None), ("two", "b", None), ("3", "c", 5), (None, "d", None)}


def test_population(spark, folder):
    write(spark, f"{folder}/bef200112.parquet", PEOPLE.format(1) + ", CAST(80 AS tinyint) AS KOM")
    write(spark, f"{folder}/bef200212.parquet", PEOPLE.format(2) + ", CAST(180 AS smallint) AS KOM")
    write(spark, f"{folder}/bef200312.parquet", "3 AS PNR, 'f' AS FAR_ID, 'm' AS MOR_ID, DATE '2002-01-01' AS FOED_DAG")
    rows = read_population(spark, f"{folder}/bef*.parquet").select("PNR", "FAMILIE_ID", "FOED_DAG", "year", "month").collect()
    assert sorted(map(tuple, rows)) == [("1", "x", date(2001, 2, 3), 2001, 12), ("2", "x", date(2001, 2, 3), 2002, 12), ("3", None, date(2002, 1, 1), 2003, 12)]
    write(spark, f"{folder}/other/bef2001.parquet", "1 AS PNR, CAST(1 AS tinyint) AS KOM")
    write(spark, f"{folder}/other/bef2002.parquet", "'1' AS PNR, CAST(1 AS smallint) AS KOM")
    with pytest.raises(ValueError, match="FAR_ID"):
        read_population(spark, f"{folder}/other/bef*.parquet")


def test_births(spark, folder):
    births = "CAST({0} AS {1}) AS CPR_BARN, CAST(7 AS {1}) AS CPR_FADER, '8' AS CPR_MODER, '2003-04-05' AS FOEDSELSDATO"
    write(spark, f"{folder}/mfr2001.parquet", births.format(1, "tinyint"))
    write(spark, f"{folder}/mfr2002.parquet", births.format(200, "smallint"))
    write(spark, f"{folder}/mfr2003.parquet", births.format(300, "string"))
    df = read_births(spark, f"{folder}/mfr*.parquet")
    assert df.columns == ["PNR", "FAR_ID", "MOR_ID", "FOED_DAG", "FAMILIE_ID", "year", "month"]
    assert sorted((r["PNR"], r["FAR_ID"], r["year"]) for r in df.collect()) == [("1", "7", 2001), ("200", "7", 2002), ("300", "7", 2003)]
    assert read_births(spark, f"{folder}/none*.parquet") is None


def test_hospital_contacts(spark, folder):
    from kinpanel.plans.cohort import HOSPITAL, Study, build_care

    for year, kind in ((2001, "tinyint"), (2002, "smallint"), (2003, "string")):
        write(spark, f"{folder}/lpr_adm/a{year}.parquet", f"'p' AS PNR, 'DE84' AS C_ADIAG, CAST({year - 2000} AS {kind}) AS RECNUM, DATE '{year}-01-01' AS D_INDDTO, DATE '{year}-01-02' AS D_UDDTO, 'A' AS C_AFD, '1' AS C_INDM")
        write(spark, f"{folder}/lpr_diag/d{year}.parquet", f"CAST({year - 2000} AS {kind}) AS RECNUM, 'DZ0' AS C_DIAG, 'DZ1' AS C_TILDIAG")
    write(spark, f"{folder}/lpr_bes/b.parquet", "'1' AS RECNUM, DATE '2001-01-01' AS D_AMBDTO")
    write(spark, f"{folder}/lpr3_kontakter/k.parquet", "'k' AS DW_EK_KONTAKT, 'p' AS CPR, 'DE1' AS aktionsdiagnose, '2020-01-05' AS dato_start, '2020-01-05' AS dato_slut, 'H' AS SORENHED_ANS, 'ATA' AS prioritet")
    write(spark, f"{folder}/lpr3_diagnoser/d.parquet", "'k' AS DW_EK_KONTAKT, 'DE2' AS diagnosekode")
    care = build_care(spark, Study({n: f"{folder}/{n}/*.parquet" for n in HOSPITAL}, f"{folder}/out"))
    assert {(r["record_id"], r["admission_date"].year, r["rows"]) for r in care.collect()} == {("1", 2001, 1), ("2", 2002, 1), ("3", 2003, 1), ("k", 2020, 1)}


def test_panel_whose_years_differ(spark, folder):
    for year, kind in ((2001, "tinyint"), (2002, "smallint"), (2003, "string")):
        write(spark, f"{folder}/panel/year={year}", f"'p' AS PNR, CAST({year - 2000} AS {kind}) AS v")
    assert {tuple(r) for r in read_panel(spark, f"{folder}/panel").select("PNR", "v", "year").collect()} == {("p", "1", 2001), ("p", "2", 2002), ("p", "3", 2003)}
    some = read_panel(spark, f"{folder}/panel", 2002, 2002)
    assert [tuple(r) for r in some.select("v", "year").collect()] == [("2", 2002)]


def test_other_writers(spark, folder):
    os.makedirs(f"{folder}/x")
    table = pa.table({"a": pa.array([1], pa.uint8()), "c": pa.array(["x"]).dictionary_encode(), "d": pa.array([date(2001, 1, 1)]), "l": pa.array([[1, 2]], pa.list_(pa.int16())), "s": pa.array([{"p": 1}], pa.struct([("p", pa.int64())]))})
    pq.write_table(table, f"{folder}/x/one two.parquet")
    pq.write_table(pa.table({"a": pa.array([2], pa.int64())}), f"{folder}/x/b.parquet")
    row = {r["path"].rsplit("/", 1)[1]: r["schema"] for r in s.file_schemas(spark, f"{folder}/x").collect()}
    assert row["one two.parquet"] == "`a` smallint, `c` string, `d` date, `l` array<smallint>, `s` struct<`p`: bigint>"
    got = read_parquet(spark, f"{folder}/x")
    assert {(r["a"], r["c"], r["d"]) for r in got.collect()} == {(1, "x", date(2001, 1, 1)), (2, None, None)}


def test_many_files_take_few_jobs(spark, folder):
    """The driver reads no footer, whatever the number of files."""
    os.makedirs(f"{folder}/many")
    for i in range(1500):
        kind = pa.int8() if i % 2 else pa.int16()
        pq.write_table(pa.table({"PNR": pa.array([str(i)]), "KOM": pa.array([i % 100], kind)}), f"{folder}/many/bef{1900 + i % 100}_{i}.parquet")
    context = spark.sparkContext
    context.setJobGroup("many files", "reading the footers")
    try:
        df = read_register(spark, "bef", f"{folder}/many/*.parquet")
        jobs = len(context.statusTracker().getJobIdsForGroup("many files"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 12 and df.count() == 1500 and dict(df.dtypes)["KOM"] == "smallint"
    assert df.filter("year is null").count() == 0


def test_stores_that_only_spark_opens(spark, folder, monkeypatch):
    for year, kind in ((2001, "tinyint"), (2002, "smallint"), (2003, "smallint"), (2004, "string")):
        write(spark, f"{folder}/x{year}.parquet", f"CAST({year - 2000} AS {kind}) AS n")
    told = spark.createDataFrame([(f"{folder}/x{y}.parquet", None, "unreachable: no such store") for y in range(2001, 2005)], "path string, schema string, error string")
    monkeypatch.setattr(s, "file_schemas", lambda *_: told)
    assert sorted(len(files) for _, files in s.type_groups(spark, f"{folder}/x*.parquet")) == [1, 3]
    assert {r["n"] for r in read_parquet(spark, f"{folder}/x*.parquet").collect()} == {"1", "2", "3", "4"}


def test_common_types():
    assert s.common_types({"tinyint", "smallint", "string"}) == {"tinyint": "smallint", "smallint": "smallint", "string": "string"}
    assert s.common_types({"int", "float", "date"}) == {"int": "double", "float": "double", "date": "date"}
    assert s.common_types({"int", "bigint", "float", "double"}) == {"int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}
    assert s.widest({"bigint", "double"}) is None and s.widest({"string"}) == "string"


def test_broken_files_are_told(spark, folder):
    write(spark, f"{folder}/a.parquet", "1 AS n")
    write(spark, f"{folder}/b.parquet", "CAST(1 AS bigint) AS n")
    os.makedirs(f"{folder}/c.parquet")
    with open(f"{folder}/c.parquet/part-00000-x.parquet", "wb") as f:
        f.write(b"no table")
    errors = {r["path"].rsplit("/", 2)[1]: r["error"] for r in s.file_schemas(spark, f"{folder}/*.parquet").collect()}
    assert errors["a.parquet"] is None and errors["c.parquet"]
    with pytest.raises(ValueError, match="c.parquet"):
        s.type_groups(spark, f"{folder}/*.parquet")
