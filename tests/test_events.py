from __future__ import annotations

from datetime import date

import pytest

from kinpanel.operators import event_reports as er
from kinpanel.operators import events as ev


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_condition_on_the_row(spark):
    df = spark.createDataFrame([("1", 2020, 10), ("2", 2021, 20), ("3", 2022, 30)], "PNR string, year bigint, value bigint")
    got = ev.identify_events(df, {"value_over_15": ev.when("value", lambda c: c > 15)})
    assert got.columns == ["event_type", "PNR", "year"]
    assert found(got) == [("value_over_15", "2", 2021), ("value_over_15", "3", 2022)]


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_changes_stay_within_a_person(spark, hot_rows):
    rows = [("a", 2000, 1), ("a", 2001, 1), ("a", 2002, 2), ("b", 2000, 9), ("b", 2001, 9), ("c", 2000, None), ("c", 2001, 3), ("c", 2002, 4)]
    df = spark.createDataFrame(rows, "PNR string, year int, KOM int")
    got = ev.identify_events(df, {"moved": ev.changed("KOM")}, hot_rows=hot_rows)
    assert found(got) == [("moved", "a", 2002), ("moved", "c", 2002)]


def test_numeric_changes(spark):
    rows = [("a", 2000, 100.0), ("a", 2001, 105.0), ("a", 2002, 120.0), ("a", 2003, 0.0), ("a", 2004, 50.0), ("a", 2005, 50.0), ("a", 2006, None), ("a", 2007, 60.0)]
    df = spark.createDataFrame(rows, "PNR string, year int, x double")
    tests = {"rise": ev.rose_by("x", 0.1), "fall": ev.fell_by("x", 0.1), "any": ev.moved("x"), "up": ev.increased("x"), "down": ev.decreased("x")}
    got = found(ev.identify_events(df, tests))
    years = {name: [y for n, _, y in got if n == name] for name in tests}
    assert years == {"rise": [2002], "fall": [2003], "any": [2001, 2002, 2003, 2004], "up": [2001, 2002, 2004], "down": [2003]}


def test_month_orders_rows_of_a_year(spark):
    df = spark.createDataFrame([("a", 2000, 2, "y"), ("a", 2000, 1, "x"), ("a", 2000, 3, "y")], "PNR string, year int, month int, g string")
    got = ev.identify_events(df, {"c": ev.changed("g")}, keep=["g", "absent"])
    assert found(got) == [("c", "a", 2000, "y")]


def test_roles_and_missing_columns(spark):
    df = spark.createDataFrame([("k", "m", 2000, "a"), ("k", "m", 2001, "b")], "CHILD_PNR string, MOTHER_PNR string, MOR_year int, MOR_EDU_LVL string")
    assert found(ev.identify_events(df, role="mother")) == [("mother_education_change", "m", 2001)]
    empty = ev.identify_events(df, role="father", keep=["MOR_EDU_LVL"])
    assert empty.count() == 0 and dict(empty.dtypes) == {"event_type": "string", "PNR": "string", "year": "bigint", "MOR_EDU_LVL": "string"}
    with pytest.raises(ValueError):
        ev.identify_events(df, role="uncle")


def test_built_in_definitions():
    assert {role: len(d) for role, d in ev.EVENTS.items()} == {"child": 6, "father": 7, "mother": 7}
    assert "significant_income_increase_father" in ev.FATHER_EVENTS


@pytest.fixture
def log(spark):
    rows = [
        ("a", "1", 2000, 10, "g", date(2000, 1, 1)), ("b", "1", 2001, 20, "g", date(2000, 1, 4)), ("a", "2", 2000, 40, "h", None),
        ("b", "2", 2001, 60, "h", date(2000, 1, 6)), ("a", "3", 2001, None, None, date(2000, 1, 3)), ("c", "3", 2002, 80, "g", date(2000, 1, 2)),
    ]
    return spark.createDataFrame(rows, "event_type string, PNR string, year int, age int, grp string, event_date date")


def test_counts_and_summary(log):
    assert [tuple(r) for r in er.event_counts(log, ordered=True).collect()] == [("a", 3), ("b", 2), ("c", 1)]
    got = {(r["category"], r["value"]): (r["count"], r["pct_cohort"], r["pct_total"]) for r in er.event_summary(log, ["grp"]).collect()}
    assert got["event_type", "a"] == (3, 100.0, 50.0)
    assert got["grp", None][0] == 1
    assert sum(v[2] for k, v in got.items() if k[0] == "event_type") == pytest.approx(100)


def test_timing(log):
    got = {r["event_type"]: tuple(r)[1:] for r in er.event_timing(log).collect()}
    assert got["a"] == (date(2000, 1, 1), date(2000, 1, 3), date(2000, 1, 2), date(2000, 1, 2))
    assert got["b"] == (date(2000, 1, 4), date(2000, 1, 6), date(2000, 1, 5), date(2000, 1, 5))
    years = {r["event_type"]: r["median"] for r in er.event_timing(log.drop("event_date")).collect()}
    assert years == {"a": 2000.0, "b": 2001.0, "c": 2002.0}
    assert er.event_dates(log).columns == ["event_date", "event_type"]


def test_frequencies(log):
    tables = er.frequency_analysis(log, ["grp"])
    assert list(tables) == ["yearly_frequency", "age_group_frequency", "grp_frequency"]
    assert [tuple(r) for r in tables["yearly_frequency"].collect()] == [(2000, "a", 2), (2001, "b", 2), (2001, "a", 1), (2002, "c", 1)]
    assert ("70+", "a", 1) in [tuple(r) for r in tables["age_group_frequency"].collect()]
    assert list(er.frequency_analysis(log.drop("age"))) == ["yearly_frequency"]


def test_group_count_matrix_and_share(log):
    assert {(r["PNR"], r["event_type"], r["count"]) for r in er.with_group_count(log).collect()} >= {("1", "a", 2), ("3", "c", 1)}
    assert {tuple(r) for r in er.count_matrix(log).collect()} == {(2000, 2, 0, 0), (2001, 1, 2, 0), (2002, 0, 0, 1)}
    shares = er.event_share(log, "year").collect()
    assert sum(r["share"] for r in shares if r["event_type"] == "a") == pytest.approx(1)
    assert er.count_matrix(log.where("grp is not null"), "year", "grp").columns == ["year", "g", "h"]
    with pytest.raises(ValueError):
        er.event_types(log, at_most=2)


def test_correlation(spark, log):
    got = {(r["event_a"], r["event_b"]): r["correlation"] for r in er.event_correlation(log).collect()}
    assert len(got) == 9
    assert got["a", "a"] is None  # everyone has one
    assert got["b", "c"] == pytest.approx(-1.0) and got["b", "b"] == pytest.approx(1.0) and got["c", "b"] == got["b", "c"]


def test_flows(spark):
    rows = []
    for i in range(3):
        rows += [(f"p{i}", 2000, "a"), (f"p{i}", 2001, "b"), (f"p{i}", 2001, "c"), (f"p{i}", 2002, "a")]
    rows += [("q", 2000, "a"), ("q", 2001, "z"), ("r", 2000, "a"), ("r", 2001, "a"), ("r", 2002, "b")]
    df = spark.createDataFrame(rows, "PNR string, year int, event_type string")
    assert found(er.event_flows(df, 5, 3)) == [("a", "b", 3), ("b", "c", 3), ("c", "a", 3)]
    assert found(er.event_flows(df, 5, 1, aggregate=False)) == [("a", "b", 1), ("a", "b", 3), ("a", "z", 1), ("b", "c", 3), ("c", "a", 3)]
    assert found(er.event_flows(df, 1, 1)) == [("Other", "a", 3), ("a", "Other", 5)]
    assert er.event_flows(df, 5, 100).count() == 0


def test_time_to_event(log):
    got = {(r["event_type"], r["PNR"]): (r["time_to_event"], r["events"]) for r in er.time_to_event(log).collect()}
    assert got["a", "3"] == (1, 1) and got["c", "3"] == (2, 1) and len(got) == 6
    assert {r["PNR"] for r in er.time_to_event(log, "b").collect()} == {"1", "2"}


def test_no_events_of_nobody(spark):
    rows = [(None, 2001, 1), (None, 2002, 5), ("a", 2001, 1), ("a", 2002, 5)]
    df = spark.createDataFrame(rows, "PNR string, year int, KOM int")
    for hot in (None, 1):
        found = ev.identify_events(df, {"move": ev.changed("KOM")}, hot_rows=hot).collect()
        assert [(r["PNR"], r["year"]) for r in found] == [("a", 2002)]


def test_fractions_rise(spark):
    df = spark.createDataFrame([("a", 1, 10.2, 10.2), ("a", 2, 10.9, 10.9), ("a", 3, 12.0, 12.0)], "PNR string, year int, x double, n double")
    found = ev.identify_events(df, {"up": ev.increased("x"), "whole": ev.more("n"), "down": ev.decreased("x")}).collect()
    assert sorted((r["event_type"], r["year"]) for r in found) == [("up", 2), ("up", 3), ("whole", 3)]


def test_correlation_of_many_types(spark):
    from kinpanel.operators import event_reports as er

    df = spark.range(3000).selectExpr("concat('e', id % 40) AS event_type", "CAST(id % 97 AS STRING) AS PNR", "2000 AS year")
    got = er.event_correlation(df)
    assert got.count() == 1600 and got.where("event_a = event_b and abs(correlation - 1) > 1e-9").isEmpty()
    assert er.count_long(df).count() == 40
    few = er.event_correlation(df, ["e1", "e2", "absent"]).collect()
    assert len(few) == 9 and all(r["correlation"] is None for r in few if "absent" in (r["event_a"], r["event_b"]))


def test_correlation_pairs_are_made_in_blocks(spark):
    """Pairs of 900 types: no row that holds all types, and no task with more than twice the usual."""
    from pyspark.sql import functions as F

    df = spark.range(3000).selectExpr("cast(id % 50 as string) PNR", "2000 year", "concat('e', id % 900) event_type")
    got = er.event_correlation(df)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sorted(r[1] for r in er.event_correlation(df).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 900 * 900 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
