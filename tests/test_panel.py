from __future__ import annotations

import pytest

from kinpanel.operators import columns as c
from kinpanel.operators import panel as pn


def test_keep_existing(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, year int, b int, month int")
    assert c.keep_existing(df, ["b", "zz"]).columns == ["b", "year", "month"]
    assert c.keep_existing(df, ["zz"], always=()).columns == df.columns
    assert c.existing(df, ["month", "a"]) == ["month", "a", "year"]


def test_keep_or_drop(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert c.keep_or_drop(df, keep=["b"]).columns == ["b"]
    assert c.keep_or_drop(df, drop=["b"]).columns == ["a"]
    with pytest.raises(ValueError):
        c.keep_or_drop(df, ["a"], ["b"])
    with pytest.raises(ValueError):
        c.require(df, ["a", "zz"])


def test_layout(spark):
    df = spark.createDataFrame([("1", "x", "9")], "a string, b string, extra string")
    got = c.apply_layout(df, {"a": "int8", "b": "category", "absent": "date"})
    assert dict(got.dtypes) == {"a": "tinyint", "b": "string", "extra": "string"}
    assert c.apply_layout(df, {"b": "int32"}, "try").first()["b"] is None
    with pytest.raises(Exception):
        c.apply_layout(df, {"b": "int32"}).collect()


def test_kinds(spark):
    df = spark.sql("select 1 a, cast(1 as tinyint) b, 1.5d c, date'2020-01-01' d, current_timestamp() e, 'x' f, true g")
    assert [c.column_kind(df, x) for x in df.columns] == ["numeric"] * 3 + ["temporal"] * 2 + ["categorical"] * 2


def test_unique_names(spark):
    df = spark.sql("select 1 a, 2 b, 3 a, 4 a")
    assert c.unique_names(df).columns == ["a", "b", "a_1", "a_2"]


def test_order(spark):
    df = spark.createDataFrame([("b", 2001), ("a", 2001), ("z", 2000)], "PNR string, year int")
    assert [r["PNR"] for r in c.in_order_of(df, ["year", "PNR"]).collect()] == ["z", "a", "b"]
    assert c.in_order_of(df, ["nope"]) is df


def _people(spark):
    return spark.createDataFrame([("1", "f", "m"), ("2", None, "m"), ("3", "x", None)], "PNR string, FAR_ID string, MOR_ID string")


def _income(spark):
    rows = [("f", 2000, 10.0), ("f", 2001, 11.0), ("m", 2001, 20.0), ("m", 2002, 21.0), ("1", 2000, 1.0)]
    return spark.createDataFrame(rows, "PNR string, year int, income double")


def test_register_join(spark):
    got = pn.join_register(_people(spark), _income(spark))
    assert {tuple(r) for r in got.select("PNR", "year").collect()} == {("1", 2000), ("2", None), ("3", None)}
    two = pn.join_register(_people(spark).withColumnRenamed("FAR_ID", "year2").selectExpr("PNR", "2000 as year"), _income(spark), ["PNR", "year"])
    assert {tuple(r) for r in two.collect()} == {("1", 2000, 1.0), ("2", 2000, None), ("3", 2000, None)}


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_parents_join(spark, hot_rows):
    got = pn.join_parents(_people(spark), _income(spark), hot_rows=hot_rows)
    assert got.columns == ["PNR", "FAR_ID", "MOR_ID", "FAR_year", "FAR_income", "MOR_year", "MOR_income"]
    assert sorted(((r["PNR"], r["FAR_year"], r["MOR_year"]) for r in got.collect()), key=str) == sorted(
        [("1", 2000, 2001), ("1", 2000, 2002), ("1", 2001, 2001), ("1", 2001, 2002), ("2", None, 2001), ("2", None, 2002), ("3", None, None)], key=str
    )


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_parents_join_same_year(spark, hot_rows):
    got = pn.join_parents(_people(spark), _income(spark), same_period=True, hot_rows=hot_rows)
    assert sorted(((r["PNR"], r["year"], r["FAR_income"], r["MOR_income"]) for r in got.collect()), key=str) == sorted(
        [("1", 2000, 10.0, None), ("1", 2001, 11.0, 20.0), ("1", 2002, None, 21.0), ("2", 2001, None, 20.0), ("2", 2002, None, 21.0), ("3", None, None, None)],
        key=str,
    )


def test_roles(spark):
    panel = pn.stack_registers([pn.join_register(_people(spark), _income(spark)), pn.join_parents(_people(spark), _income(spark), same_period=True)])
    roles = pn.split_roles(panel)
    assert roles["child"].columns == ["PNR", "year", "income"]
    assert roles["mother"].columns == ["CHILD_PNR", "year", "MOTHER_PNR", "MOR_year", "MOR_income"]
    assert roles["father"].columns == ["CHILD_PNR", "year", "FATHER_PNR", "FAR_year", "FAR_income"]
    assert list(pn.split_roles(_income(spark))) == ["child"]


def test_stack_needs_a_register():
    with pytest.raises(ValueError):
        pn.stack_registers([])


def test_dictionary_and_register_labels(spark):
    df = spark.createDataFrame([("1", "81", "5100"), ("9", "x", None)], "HUSTYPE string, REG string, STATSB string")
    country = spark.createDataFrame([("5100", "Danmark")], "code string, label string")
    got = pn.label_codes(df, "bef", {"statsb": country}).collect()
    assert {tuple(r) for r in got} == {("En enlig mand", "Nordjylland", "Danmark"), ("9", "x", None)}
    plain = pn.label_codes(df, "bef").collect()
    assert {r["STATSB"] for r in plain} == {"5100", None}
    levels = spark.createDataFrame([("10", "2")], "HFAUDD string, EDU_LVL string")
    codes = spark.createDataFrame([("10",), ("11",), (None,)], "HFAUDD string")
    assert {tuple(r) for r in pn.add_education_level(codes, levels).collect()} == {("10", "2"), ("11", None), (None, None)}


def test_year_gaps(spark):
    df = spark.createDataFrame([(2000,), (2003,), (2003,), (None,)], "year int")
    assert sorted(r[0] for r in pn.year_gaps(df).collect()) == [2001, 2002]
    assert pn.year_gaps(df.where("false")).count() == 0
