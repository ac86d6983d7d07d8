from __future__ import annotations

from datetime import date

import numpy as np
import pytest

from kinpanel.operators import statistics as s
from kinpanel.operators import tables as t
from kinpanel.plans import zones as z


@pytest.fixture
def df(spark):
    rows = [
        ("a", 2000, 1.0, "x", date(2001, 1, 1)),
        ("b", 2000, 2.0, "x", None),
        ("c", 2000, None, None, date(2000, 1, 1)),
        ("d", 2001, 10.0, "y", date(2002, 1, 1)),
    ]
    return spark.createDataFrame(rows, "PNR string, year int, v double, g string, d date")


def test_numeric(df):
    for method in ("auto", "selection", "builtin"):
        r = s.numeric_statistics(df, ["v"], quantiles=method).first()
        values = [1.0, 2.0, 10.0]
        assert (r["column"], r["count"], r["missing"], r["min"], r["max"]) == ("v", 3, 1, 1.0, 10.0)
        assert r["mean"] == pytest.approx(np.mean(values)) and r["std"] == pytest.approx(np.std(values, ddof=1))
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]))
    assert s.numeric_statistics(df, ["v"], quantiles="approx").count() == 1
    with pytest.raises(ValueError):
        s.numeric_statistics(df, ["v"], quantiles="other")
    with pytest.raises(ValueError):
        s.numeric_statistics(df, ["absent"])


def test_numeric_column_without_values(df):
    r = s.numeric_statistics(df.where("v is null"), ["v"]).first()
    assert (r["count"], r["missing"], r["mean"], r["median"]) == (0, 1, None, None)


def test_grouping_column_can_be_described(df):
    got = {(r["year"], r["column"]): r["mean"] for r in s.numeric_statistics(df, ["year", "v"], ["year"]).collect()}
    assert got[2001, "year"] == 2001.0 and got[2000, "v"] == 1.5


def test_categorical(df):
    got = {r["value"]: r for r in s.categorical_statistics(df, ["g"]).collect()}
    assert {k: (r["count"], r["percentage"], r["missing"], r["total"]) for k, r in got.items()} == {
        "x": (2, 50.0, 1, 4), None: (1, 25.0, 1, 4), "y": (1, 25.0, 1, 4),
    }
    by_year = {(r["year"], r["value"]): r["percentage"] for r in s.categorical_statistics(df, ["g"], ["year"]).collect()}
    assert by_year[2001, "y"] == 100.0 and by_year[2000, None] == pytest.approx(100 / 3)


def test_temporal(df):
    assert tuple(s.temporal_statistics(df, ["d"]).first()) == ("d", 3, date(2000, 1, 1), date(2002, 1, 1), 1)


def test_table_statistics(df):
    got = {r["column"]: r for r in s.table_statistics(df.drop("PNR"), by=["year"]).where("year = 2000").collect()}
    assert got["v"]["stat_type"] == "numeric" and got["v"]["value"] == 1.5 and got["v"]["median"] == 1.5
    assert got["g"]["stat_type"] == "categorical" and got["g"]["count"] == 3 and got["g"]["value"] == pytest.approx(200 / 3)
    assert got["d"]["stat_type"] == "temporal" and got["d"]["value_text"] == "2000-01-01" and got["d"]["std"] == 0.0
    with pytest.raises(ValueError):
        s.table_statistics(df, ["absent"], [], [])


def test_domain_statistics(df):
    panel = df.withColumnRenamed("v", "ANTPERSH").withColumnRenamed("g", "REG")
    named = z.domain_panel(panel)
    assert {"household_size", "region"} <= set(named.columns)
    stats = z.domain_statistics(named, {"numeric": ["household_size"], "categorical": ["region", "municipality"]})
    assert {(r["year"], r["column"]) for r in stats.collect()} == {(y, c) for y in (2000, 2001) for c in ("household_size", "region")}
    assert z.domain_statistics(named.drop("year"), {"numeric": ["household_size"]}) is None
    assert z.domain_statistics(named, {"numeric": ["absent"]}) is None


def test_stratified(df):
    got = {r["stratum"]: (r["n"], r["mean"], r["missing"]) for r in s.stratified_statistics(df, ["v"], "g").collect()}
    assert got == {"x": (2, 1.5, 0), "y": (1, 10.0, 0)}
    assert s.stratified_statistics(df, ["v"]).first()["stratum"] == "all"


def test_describe_and_missing(df):
    got = {r["variable"]: r for r in s.describe(df).collect()}
    assert got["v"]["null_count"] == 1 and got["v"]["q3"] == 6.0
    assert got["d"]["min_text"] == "2000-01-01" and got["g"]["max_text"] == "y" and got["g"]["mean"] is None
    missing = {r["column"]: (r["missing"], r["percentage"]) for r in s.missing_table(df).collect()}
    assert missing == {"PNR": (0, 0.0), "year": (0, 0.0), "v": (1, 25.0), "g": (1, 25.0), "d": (1, 25.0)}
    assert {r["column"]: r["non_null"] for r in s.non_null_counts(df).collect()}["d"] == 3
    counts, sample = s.glance(df, 2)
    assert counts.count() == 5 and sample.count() == 2


def test_profile(df):
    got = {r["column"]: r for r in s.profile(df).collect()}
    assert (got["g"]["dtype"], got["g"]["rows"], got["g"]["missing"], got["g"]["distinct_values"]) == ("string", 4, 1, 3)
    assert got["g"]["min"] is None and got["v"]["median"] == 2.0 and got["year"]["max"] == 2001.0
    assert s.profile(df, approx=True).count() == 5
    assert s.profile(df.select("g")).first()["median"] is None


def test_distribution(df):
    got = [tuple(r) for r in t.distribution(df, "g", [2000]).collect()]
    assert got == [(2000, "x", 2, 50.0), (2000, None, 1, 25.0)]
    assert t.distribution(df, "g").columns == ["value", "count", "percentage"]


def test_baseline(spark):
    rows = [
        ("1", 2005, date(2000, 1, 1), date(1970, 1, 1), "K", "A", 3, 100.0, "high"),
        ("2", 2005, date(2001, 1, 1), None, "M", "A", 4, 300.0, None),
        ("1", 2006, date(2000, 1, 1), date(1970, 1, 1), "K", "B", 5, 9_000.0, "low"),
    ]
    df = spark.createDataFrame(
        rows, "PNR string, year int, FOED_DAG date, MOR_FDAG date, KOEN string, FAMILIE_TYPE string, ANTPERSH int, MOR_PERINDKIALT_13 double, MOR_EDU_LVL string"
    )
    table = t.baseline_table(df, [2005], reference_date="2010-01-01").cache()
    got = {(r["variable"], r["period"], r["value"]): r for r in table.collect()}
    assert got["Total children", None, None]["n"] == 2
    assert got["Mother's income (DKK)", 2005, None]["mean"] == 200.0
    assert ("Mother's income (DKK)", 2006, None) not in got
    assert got["Mother's age at child birth", None, None]["missing_pct"] == 50.0
    assert got["Mother's education", 2005, None]["missing"] == 1
    assert got["Family type", None, "A"]["percentage"] == 100.0
    text = {(r["Variable"], r["Year"]): r for r in t.baseline_text(table).collect()}
    assert text["Total children", "All"]["Value"] == "2"
    assert text["Mother's income (DKK)", "2005"]["Value"] == "Mean: 200 (SD: 141)\nMedian: 200 (IQR: 150-250)"
    assert text["Mother's education: high", "2005"]["Value"] == "1 (50.0%)"
    assert text["Mother's age at child birth", "All"]["Missing"] == "50.0%"
    by_sex = t.baseline_table(df, [2005], stratify_by="KOEN", reference_date="2010-01-01")
    strata = {r["stratum"]: r["mean"] for r in by_sex.where("variable = \"Mother's income (DKK)\"").collect()}
    assert strata == {"K": 100.0, "M": 300.0}
