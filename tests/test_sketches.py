"""Profiles from sketches kept by year, against the rows."""

from __future__ import annotations

import pytest

from kinpanel.operators import sketches as k
from kinpanel.operators.statistics import profile
from kinpanel.sources.sketches import profile_panel, sketch_path, write_sketches
from kinpanel.sources.tables import write_panel


@pytest.fixture(scope="module")
def panel(spark):
    return spark.range(60_000).selectExpr("cast(id % 4 + 2000 as int) year", "cast(id * 7 % 20011 as string) PNR", "case when id % 3 > 0 then id % 500 end v", "cast(null as double) w", "date_add(date'2000-01-01', cast(id % 90 as int)) d")


def test_estimates_stay_within_their_error(spark, folder, panel):
    write_panel(panel, f"{folder}/p")
    write_sketches(spark, f"{folder}/p")
    for years in ((None, None), (2001, 2002)):
        df = panel if years[0] is None else panel.filter(f"year between {years[0]} and {years[1]}")
        got = {r["column"]: r for r in profile_panel(spark, f"{folder}/p", *years).collect()}
        want = {r["column"]: r for r in profile(df.drop("year")).collect()}
        assert set(got) == set(want)
        for c, w in want.items():
            g = got[c]
            assert (g["dtype"], g["rows"], g["missing"], g["min"], g["max"]) == (w["dtype"], w["rows"], w["missing"], w["min"], w["max"])
            assert g["distinct_values"] == pytest.approx(w["distinct_values"], rel=4 * k.ERROR, abs=1)
            assert (g["mean"] is None) == (w["mean"] is None) and (w["mean"] is None or g["mean"] == pytest.approx(w["mean"]))
        assert got["v"]["median"] == pytest.approx(want["v"]["median"], abs=500 * 0.03) and got["w"]["median"] is None


def test_profile_reads_sketches_only(spark, folder, panel):
    write_panel(panel, f"{folder}/p")
    write_sketches(spark, f"{folder}/p")
    plan = profile_panel(spark, f"{folder}/p")._jdf.queryExecution().executedPlan().toString()
    assert "/p_sketches]" in plan and "/p]" not in plan
    # One year is sketched again; merged sketches are those of all rows.
    write_panel(panel.filter("year = 2003").selectExpr("year", "concat('n', PNR) PNR", "v", "w", "d"), f"{folder}/p", only_given=True)
    write_sketches(spark, f"{folder}/p", frozenset({2003}))
    assert spark.read.parquet(sketch_path(f"{folder}/p")).groupBy("year").count().count() == 4
    new = {r["column"]: r["distinct_values"] for r in profile_panel(spark, f"{folder}/p").collect()}
    exact = panel.filter("year < 2003").select("PNR").distinct().count() + panel.filter("year = 2003").select("PNR").distinct().count()
    assert new["PNR"] == pytest.approx(exact, rel=4 * k.ERROR)


def test_no_rows(spark, panel):
    assert k.profile_of_sketches(k.sketch_columns(panel.limit(0))).collect() == []


def test_heavy_keys_from_sketches(spark, folder):
    """Sketches of the years merge to the table's heavy keys; joins that know them start no search."""
    from kinpanel.operators.panel import join_parent, join_register
    from kinpanel.operators.scale import hot_keys
    from kinpanel.sources.sketches import stored_hot_keys, write_key_sketches

    panel = spark.range(9000).selectExpr("cast(id % 3 + 2000 as int) year", "case when id % 2 = 0 then 'h' when id % 9 = 1 then null else cast(id as string) end PNR", "id v")
    write_panel(panel, f"{folder}/p")
    assert stored_hot_keys(spark, f"{folder}/p", "PNR") is None
    write_key_sketches(spark, f"{folder}/p", ["PNR"])
    for with_null in (False, True):
        found = stored_hot_keys(spark, f"{folder}/p", "PNR", 400, with_null)
        assert sorted(map(str, found)) == sorted(map(str, hot_keys(panel, "PNR", 400, with_null))) and len(found) == 1 + with_null
    write_panel(panel.filter("year = 2001").selectExpr("year", "'g' PNR", "v"), f"{folder}/p", only_given=True)
    write_key_sketches(spark, f"{folder}/p", ["PNR"], frozenset({2001}))
    assert dict(stored_hot_keys(spark, f"{folder}/p", "PNR", 400)) == {"h": 3000, "g": 3000}
    people = spark.createDataFrame([("h", "g", None), ("x", None, "h")], "PNR string, FAR_ID string, MOR_ID string")
    register = spark.read.parquet(f"{folder}/p")
    hot = stored_hot_keys(spark, f"{folder}/p", "PNR", 400)
    spark.sparkContext.setJobGroup("joins", "plan")
    joined = [join_register(people, register, hot_rows=400, left_hot=[], right_hot=hot), join_parent(people, register, "father", hot_rows=400, left_hot=[], right_hot=hot)]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("joins"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 0 and [df.count() for df in joined] == [3001, 3001]
