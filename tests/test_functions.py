from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinpanel.fixed_values import LABELS
from kinpanel.functions import codes, dates, labels, text


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2023/05/15", date(2023, 5, 15)),
        ("15/05/2023", date(2023, 5, 15)),
        ("05/15/2023", date(2023, 5, 15)),
        ("2023/05/15 10:11:12", date(2023, 5, 15)),
        ("05/15/23", date(2023, 5, 15)),
        ("05/15/85", date(1985, 5, 15)),
        ("15May2023", date(2023, 5, 15)),
        ("15MAY2023", date(2023, 5, 15)),
        ("2023-05-15", date(2023, 5, 15)),
        ("15-05-2023", date(2023, 5, 15)),
        ("05-15-2023", date(2023, 5, 15)),
        ("2023-05-15 01:02:03", date(2023, 5, 15)),
        ("Mon May 15 01:02:03 2023", date(2023, 5, 15)),
        ("Mon May  5 01:02:03 2023", date(2023, 5, 5)),
        # Day before month where both would fit.
        ("03/04/2023", date(2023, 4, 3)),
        ("junk", None),
        ("", None),
        (None, None),
        ("2023-02-30", None),
    ],
)
def test_parse_date(spark, value, expected):
    df = spark.createDataFrame([(value,)], "s string")
    assert df.select(dates.parse_date("s")).first()[0] == expected


def test_parse_date_leaves_dates_alone(spark):
    df = spark.createDataFrame([(date(2020, 1, 2), datetime(2020, 1, 2, 3, 4))], "d date, t timestamp")
    got = df.select(dates.parse_date("d", T.DateType()), dates.parse_date("t", T.TimestampType())).first()
    assert tuple(got) == (date(2020, 1, 2), date(2020, 1, 2))


@pytest.mark.parametrize(
    "name,year,month",
    [("bef_202312.parquet", 2023, 12), ("bef2019.parquet", 2019, None), ("bef.parquet", None, None), ("a12_2001.x.parquet", 2001, None)],
)
def test_file_period(spark, name, year, month):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(df.select(dates.file_year(F.col("n")), dates.file_month(F.col("n"))).first()) == (year, month)


def test_age_band_and_gap(spark):
    df = spark.createDataFrame([(18,), (19,), (50,), (51,), (71,), (None,)], "a int")
    assert [r[0] for r in df.select(dates.age_band("a")).collect()] == ["0-18", "19-30", "31-50", "51-70", "70+", "70+"]
    gap = spark.createDataFrame([(date(2010, 1, 1), date(1980, 1, 1))], "c date, p date").select(dates.years_between("c", "p"))
    assert gap.first()[0] == pytest.approx(10958 / 365.25)


def test_code_lists():
    assert len(codes.scd_categories()) == len(set(codes.scd_categories())) == 222
    assert codes.expand_ranges(["D55-D57", "A01"]) == ["D55", "D56", "D57", "A01"]
    groups = codes.group_categories()
    assert len(groups) == 10
    assert groups["Congenital"][0] == "P27" and groups["Congenital"][-1] == "Q99"


@pytest.mark.parametrize(
    "code,category,literal",
    [
        ("DE840", True, False),
        ("DE84", True, True),
        ("DG40", True, True),
        ("DG400", True, False),
        ("dg400", True, False),
        ("DE750", True, True),
        ("DE81", True, True),
        ("DP941", True, True),
        ("DP9415", True, True),
        ("DP940", False, False),
        ("DZ000", False, False),
        ("INVALID", False, False),
        ("", False, False),
        (None, False, False),
    ],
)
def test_scd_code(spark, code, category, literal):
    df = spark.createDataFrame([(code,)], "c string")
    got = df.select(codes.is_scd_code("c"), codes.is_scd_code("c", "literal")).first()
    assert tuple(got) == (category, literal)


def test_unknown_mode():
    with pytest.raises(ValueError):
        codes.is_scd_code("c", "other")


def test_group_membership(spark):
    df = spark.createDataFrame([("DD56", None), (None, "DD600"), ("DD62", None)], "a string, b string")
    got = df.select(codes.in_group(["a", "b"], "Blood Disorders"), codes.in_group(["a", "b"], "Blood Disorders", "literal")).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (False, False)]
    one = spark.createDataFrame([("DD76",)], "a string").select(codes.in_group(["a"], "Blood Disorders", "literal"))
    assert one.first()[0] is True


def test_labels(spark):
    df = spark.createDataFrame([("81",), ("7",), (None,)], "r string")
    assert [r[0] for r in df.select(labels.label("r", LABELS["reg"])).collect()] == ["Nordjylland", "7", None]
    sizes = {k: len(v) for k, v in LABELS.items()}
    assert sizes == {
        "beskst13": 13, "civst": 9, "fm_mark": 6, "hustype": 6, "jobkat": 7, "plads": 3, "pre_socio": 17, "reg": 6, "socio13": 22, "tilknyt": 20,
    }
    with pytest.raises(ValueError):
        labels.label("r", {str(i): "x" for i in range(100)})


def test_text(spark):
    one = spark.createDataFrame([(1234.56, 2.0, 1000.0, 10.5, 2000.0, 1500, 12.34)], "m double, s double, d double, a double, b double, n int, p double")
    got = one.select(
        text.mean_median(*[F.col(c) for c in "msdab"]), text.count_share(F.col("n"), F.col("p")), text.percent(F.col("p"))
    ).first()
    assert got[0] == "Mean: 1,234.6 (SD: 2.0)\nMedian: 1,000.0 (IQR: 10.5-2,000.0)"
    assert got[1] == "1,500 (12.3%)"
    assert got[2] == "12.3%"
