"""Tables in buckets by person: joins that leave them in place, partial writing, other sessions."""

from __future__ import annotations

import glob
import os
import re

import pytest

from kinpanel.operators.panel import join_parent, join_register
from kinpanel.sources.buckets import bucket_count, read_bucketed, write_bucketed
from kinpanel.sources.tables import read_panel, write_panel, write_table

PANEL = "cast(id % 400 as string) PNR, cast(2000 + id % 5 as int) year, cast(id % 7 as int) KOM, id v"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(df):
    """Lines of the plan below each join child: whether a shuffle stands above the scan of the table."""
    text = plan(df)
    return text, [line for line in text.splitlines() if "Exchange" in line]


@pytest.fixture
def tables(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    panel = spark.range(2000).selectExpr(*PANEL.split(", "))
    people = spark.range(300).selectExpr("cast(id as string) PNR", "cast(id % 90 as string) FAR_ID", "case when id % 5 > 0 then cast(id % 80 + 100 as string) end MOR_ID", "date'2000-01-01' FOED_DAG")
    write_panel(panel, f"{folder}/plain")
    write_table(people, f"{folder}/people")
    yield panel, people, write_bucketed(panel, f"{folder}/panel", buckets=16), write_bucketed(people, f"{folder}/population", buckets=16, year=None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_role_joins_move_the_population_only(spark, folder, tables, as_rows):
    _, _, panel, population = tables
    plain, people = read_panel(spark, f"{folder}/plain"), spark.read.parquet(f"{folder}/people")
    for join, moved in ((join_register, 0), (lambda a, b: join_parent(a, b, "father"), 1), (lambda a, b: join_parent(a, b, "mother"), 1)):
        got, want = join(population, panel), join(people, plain)
        text, exchanges = sides(got)
        # The panel is read in its buckets and never shuffled; the population is, where it joins by a parent.
        assert len(exchanges) == moved and len(sides(want)[1]) == 2, text
        assert "Bucketed: true" in text and all("hashpartitioning(__lkey" in e for e in exchanges)
        order = sorted(want.columns)
        assert as_rows(got.select(*order)) == as_rows(want.select(*order))


def test_years_are_replaced_alone(spark, folder, tables):
    panel, _, _, _ = tables
    path = f"{folder}/panel"
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/year=*/*.parquet")}
    new = panel.filter("year = 2003").selectExpr("PNR", "year", "v + 1 as v", "'n' as more")
    table = write_bucketed(new, path, only_given=True)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/year=*/*.parquet")}
    assert {f for f in before if "2003" not in f} == {f for f in after if "2003" not in f and after[f] == before[f]}
    assert not {f for f in before if "2003" in f} & set(after)
    rows = {tuple(r) for r in table.select("PNR", "year", "KOM", "v", "more").collect()}
    assert rows == {(r["PNR"], r["year"], None if r["year"] == 2003 else r["KOM"], r["v"] + (r["year"] == 2003), "n" if r["year"] == 2003 else None) for r in panel.collect()}
    assert len(glob.glob(f"{path}/year=2003/*.parquet")) <= 16
    assert "Bucketed: true" in plan(table.groupBy("PNR").count()) and not re.search("Exchange", plan(table.groupBy("PNR").count()))


def test_another_session_opens_them(spark, folder, tables):
    panel = tables[0]
    spark.sql("SHOW TABLES").collect()
    for row in spark.sql("SHOW TABLES LIKE 'panel_*'").collect():
        spark.sql(f"DROP TABLE {row['tableName']}")
    again = read_bucketed(spark, f"{folder}/panel")
    assert again.count() == 2000 and again.filter("year = 2002").count() == panel.filter("year = 2002").count()
    assert "PartitionFilters: [isnotnull(year" in plan(again.filter("year = 2002"))
    with pytest.raises(ValueError):
        read_bucketed(spark, f"{folder}/nothing")
    with pytest.raises(ValueError):
        write_bucketed(panel, f"{folder}/few", buckets=2)
    assert bucket_count(spark, f"{folder}/panel") == 8


def test_study_in_buckets(spark, folder):
    from kinpanel.plans import cohort as c

    for year in (2010, 2011):
        spark.range(40).selectExpr("cast(id as string) PNR", "cast(id % 9 + 50 as string) FAR_ID", "cast(id % 7 + 50 as string) MOR_ID", "'f' FAMILIE_ID", "'2001-01-01' FOED_DAG", f"cast(id % 5 + {year} as int) KOM").write.parquet(f"{folder}/bef/bef{year}.parquet")
        spark.range(70).selectExpr("cast(id as string) PNR", "cast(id as double) PERINDKIALT_13").write.parquet(f"{folder}/ind/ind{year}.parquet")
    paths = {"bef": f"{folder}/bef/*.parquet", "ind": f"{folder}/ind/*.parquet"}
    out = {}
    for n in (None, 8):
        study = c.Study(paths, f"{folder}/out{n}", 2000, 2004, buckets=n)
        population = c.build_population(spark, study)
        roles = c.build_role_panels(spark, study, population, c.build_panels(spark, study))
        out[n] = {k: sorted(map(str, df.select(*sorted(df.columns)).collect())) for k, df in roles.items()}
    assert out[None] == out[8] and all(out[8].values())
