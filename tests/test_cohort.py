"""The whole study from register files to reports, on a small made-up country."""

from __future__ import annotations

import glob
import os
import random
import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from kinpanel.operators import health as h
from kinpanel.operators.population import relationships
from kinpanel.plans import cohort as c
from kinpanel.sources.manifest import Change, find_change, mark_done
from kinpanel.sources.tables import read_panel, row_marks


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("study"))
    rng = random.Random(1)

    def put(rows, schema, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/{name}")

    children = [(f"c{i}", f"f{i // 2}", f"m{i // 3}", f"fam{i // 2}", f"{2000 + i % 5}-0{1 + i % 9}-15") for i in range(30)]
    parents = [(f"f{i}", None, None, None, f"19{60 + i}-01-01") for i in range(15)] + [(f"m{i}", None, None, None, f"19{65 + i}-01-01") for i in range(10)]
    for year in (2010, 2011, 2012):
        rows = [(*p, rng.randrange(80, 84), rng.randrange(1, 6), rng.choice("KM"), rng.choice("AB"), "1", "v") for p in children + parents]
        put(rows, "PNR string, FAR_ID string, MOR_ID string, FAMILIE_ID string, FOED_DAG string, KOM int, ANTPERSH int, KOEN string, FAMILIE_TYPE string, REG string, VERSION string", f"bef/bef_{year}12.parquet")
        people = [p[0] for p in children + parents]
        put([(p, rng.random() * 1e6, rng.randrange(1, 5), "v") for p in people], "PNR string, PERINDKIALT_13 double, BESKST13 int, VERSION string", f"ind/ind{year}.parquet")
        put([(p, rng.choice(["131", "132"]), "x", "v") for p in people], "PNR string, SOCIO13 string, SENR string, VERSION string", f"akm/akm{year}.parquet")
        put([(p, rng.choice(["10", "20", "30"]), "v") for p in people], "PNR string, HFAUDD string, VERSION string", f"uddf/uddf_{year}.parquet")
    put([("c1", "f9", "m9", "2001-01-01"), ("n1", "f1", "m1", "2003-03-03")], "CPR_BARN string, CPR_FADER string, CPR_MODER string, FOEDSELSDATO string", "mfr/mfr.parquet")
    contacts = [(f"c{i}", "DE840" if i % 4 == 0 else "DZ000", f"r{i}", date(2010, 1, 1 + i % 28), date(2010, 2, 1), "A", "1") for i in range(20)]
    put(contacts, "PNR string, C_ADIAG string, RECNUM string, D_INDDTO date, D_UDDTO date, C_AFD string, C_INDM string", "lpr_adm/x.parquet")
    put([(f"r{i}", "DJ45", "DZ00") for i in range(0, 20, 5)], "RECNUM string, C_DIAG string, C_TILDIAG string", "lpr_diag/x.parquet")
    put([(f"r{i}", date(2010, 3, 1)) for i in range(0, 20, 2)], "RECNUM string, D_AMBDTO date", "lpr_bes/x.parquet")
    put([(f"k{i}", f"c{i}", "DD56" if i == 29 else "DZ00", "01Jan2020", "2020-01-05", "H", "ATA") for i in range(20, 30)], "DW_EK_KONTAKT string, CPR string, aktionsdiagnose string, dato_start string, dato_slut string, SORENHED_ANS string, prioritet string", "lpr3_kontakter/x.parquet")
    put([("k20", "DE101")], "DW_EK_KONTAKT string, diagnosekode string", "lpr3_diagnoser/x.parquet")
    names = ("bef", "mfr", "ind", "akm", "uddf", *c.HOSPITAL)
    levels = spark.createDataFrame([("10", "1"), ("20", "2")], "HFAUDD string, EDU_LVL string")
    registers = {n: f"{base}/{n}/*.parquet" for n in names}
    return c.Study(registers, f"{base}/out", 2000, 2004, with_labels=True, education_levels=levels)


@pytest.fixture(scope="module")
def built(spark, study):
    return c.build_cohort(spark, study)


def test_cohort(built):
    rows = {r["PNR"]: r for r in built.collect()}
    assert len(rows) == 31 and rows["n1"]["is_scd"] is False
    flagged = {k for k, r in rows.items() if r["is_scd"]}
    assert flagged == {f"c{i}" for i in range(20) if i % 4 == 0 or i % 5 == 0} | {"c29"}
    assert rows["c29"]["first_scd_date"] == date(2020, 1, 1)
    assert rows["c1"]["FAR_ID"] == "f0" and rows["c1"]["FAR_FDAG"] == date(1960, 1, 1)


def test_zones(spark, study, built):
    base = f"{study.output}/analytical_data"
    static = spark.read.parquet(f"{base}/static/individual_attributes")
    assert {(r["role"], r["count"]) for r in static.groupBy("role").count().collect()} == {("child", 31), ("father", 31), ("mother", 31)}
    assert spark.read.parquet(f"{base}/family/family_relationships").count() == 31
    assert spark.read.parquet(f"{base}/derived/family_statistics").where("number_of_children = 2").count() == 15
    bef = spark.read.parquet(f"{base}/longitudinal/demographics/bef")
    assert {"household_size", "municipality", "region", "year", "month"} <= set(bef.columns) and "VERSION" not in bef.columns
    assert bef.where("region = '1'").count() == bef.count()  # no label for this code
    stats = spark.read.parquet(f"{base}/derived/statistics/longitudinal/demographics")
    assert stats.count() == 9
    assert spark.read.parquet(f"{base}/derived/statistics/longitudinal/income").where("stat_type = 'numeric'").count() == 3
    health = spark.read.parquet(f"{base}/longitudinal/health/health_summary")
    assert health.where("year = 2010").count() == 20 and health.where("year = 2020").count() == 10
    groups = spark.read.parquet(f"{base}/longitudinal/health/diagnosis_groups")
    assert groups.agg({"num_blood_disorders_diagnoses": "sum"}).first()[0] == 1
    assert spark.read.parquet(f"{base}/derived/statistics/static").count() == 2
    assert spark.read.json(f"{base}/catalogue").count() == 9


def test_events_and_reports(spark, study, built, folder):
    population = spark.read.parquet(f"{study.output}/population")
    panels = c.build_panels(spark, study)
    roles = c.build_role_panels(spark, study, population, panels)
    assert set(roles) == {"child", "mother", "father"}
    assert glob.glob(f"{study.output}/long/mother/MOR_year=*") and glob.glob(f"{study.output}/long/child/year=*")
    events = c.build_events(spark, study, roles)
    types = {r[0] for r in events.select("event_type").distinct().collect()}
    assert {"municipality_change", "mother_income_change", "father_education_change"} <= types
    c.write_event_reports(events, f"{folder}/e")
    c.write_event_figures(events, f"{folder}/f", min_count=1)
    c.write_population_reports(population, f"{folder}/p")
    c.write_scd_report(built, f"{folder}/s")
    reports = {"e/event_counts", "e/event_timing", "e/event_proportions", "f/event_correlation", "f/flows", "f/event_occurrences", "p/basic_stats", "p/missing_data", "p/parent_child_age_diff", "s"}
    for name in reports:
        assert glob.glob(f"{folder}/{name}/*.csv"), name
    assert glob.glob(f"{folder}/f/survival_data/event_type=*/*.csv")
    c.write_baseline(panels["bef"], f"{folder}/t", study_years=[2010], reference_date="2012-01-01")
    assert spark.read.csv(f"{folder}/t", header=True, multiLine=True).where("Variable = 'Total children'").first()["Value"] == "55"
    assert relationships(population).count() == 31


def test_without_hospital_registers(spark, study, folder):
    only = c.Study({"bef": study.registers["bef"]}, f"{folder}/out", 2000, 2004)
    assert c.build_cohort(spark, only).count() == 30


def test_persons_are_counted_in_passing(spark, folder, monkeypatch):
    """The write itself tells persons and cases; a person lost or doubled ends the job."""
    monkeypatch.setattr(h, "check_people_kept", None)
    study = c.Study({}, folder)
    people = spark.range(50).selectExpr("cast(id as string) PNR", "date'2000-01-01' FOED_DAG")
    c._remember(spark, study, "population", c._named("people", people.agg(*[v.alias(k) for k, v in row_marks("PNR").items()]).first().asDict()))
    care = people.filter("PNR < '2'").selectExpr("PNR patient_id", "true is_scd", "FOED_DAG admission_date")
    spark.sparkContext.setJobGroup("cohort", "write")
    c._write_cohort(spark, study, people, care)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cohort"))
    spark.sparkContext.setJobGroup("plain", "write")
    h.add_flags(people, h.care_flags(care)).write.parquet(f"{folder}/plain")
    plain = len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= plain + 4  # reading and writing the few measures
    told = c._part("scd", c._told(spark, study, "cohort"))
    assert told == {"total_patients": "50", "scd_positive": "12", "scd_negative": "38", "has_scd_date": "12"}
    for broken in (people.limit(49), people.unionByName(people.limit(1)), people.selectExpr("concat(PNR, 'x') PNR", "FOED_DAG")):
        with pytest.raises(ValueError, match="persons"):
            c._write_cohort(spark, study, broken, care)


def test_whole_study_runs_once(spark, study, folder):
    whole = c.Study(study.registers, f"{folder}/out", 2000, 2004, education_levels=study.education_levels)
    assert c.build_study(spark, whole) and not c.build_study(spark, whole)
    report = {r["metric"]: r["value"] for r in spark.read.csv(f"{folder}/out/reports/scd", header=True).collect()}
    assert report == {"Total Population": "31.0", "SCD Cases": "9.0", "Prevalence (%)": "29.03"}
    summary = spark.read.csv(f"{folder}/out/reports/scd_summary", header=True, inferSchema=True).first().asDict()
    assert summary == h.scd_summary(spark.read.parquet(f"{folder}/out/cohort")).first().asDict()
    for name in ("scd", "baseline_by_sex", "events/event_counts", "figures/event_correlation", "baseline", "population/basic_stats"):
        assert glob.glob(f"{folder}/out/reports/{name}/*.csv"), name


def files(base, *names):
    """Files of each folder below the tables given, with their times of change."""
    found = {}
    for name in names:
        for f in glob.glob(f"{base}/{name}/**/*.parquet", recursive=True):
            found.setdefault(os.path.dirname(f).removeprefix(f"{base}/"), set()).add((os.path.basename(f), os.stat(f).st_mtime_ns))
    return found


TABLES = ("panels/ind", "panels/akm", "panels/bef", "long/child", "long/mother", "long/father", "analytical_data/longitudinal/income", "population")


@pytest.fixture(scope="module")
def copy(study, tmp_path_factory):
    """The registers in a place where they may be changed."""
    base = str(tmp_path_factory.mktemp("copy"))
    for name, path in study.registers.items():
        shutil.copytree(path.removesuffix("/*.parquet"), f"{base}/{name}")
    return base


def whole(study, base, out):
    return c.Study({n: f"{base}/{n}/*.parquet" for n in ("bef", "mfr", "ind", "akm")}, out, 2000, 2004)


def replace(spark, base, file, change):
    """One register file written anew."""
    df = change(spark.read.parquet(f"{base}/{file}"))
    rows = spark.createDataFrame(df.collect(), df.schema)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{base}/{file}")
    spark.catalog.refreshByPath(f"{base}/{file}")


def same_rows(spark, a, b, names):
    for name in names:
        left, right = (read_panel(spark, f"{x}/{name}") for x in (a, b))
        order = sorted(left.columns)
        assert order == sorted(right.columns), name
        rows = [sorted(map(str, df.select(*order).collect())) for df in (left, right)]
        assert rows[0] == rows[1], name


def test_one_changed_file_rewrites_its_year(spark, study, copy, folder):
    one = whole(study, copy, f"{folder}/one")
    assert c.build_study(spark, one)
    before = files(one.output, *TABLES)
    replace(spark, copy, "ind/ind2011.parquet", lambda df: df.withColumn("PERINDKIALT_13", F.col("PERINDKIALT_13") * 2).filter("PNR <> 'f3'"))
    assert c.build_study(spark, one)
    after = files(one.output, *TABLES)
    changed = {k for k in before if before[k] != after.get(k)}
    assert {"panels/ind/year=2011", "long/mother/MOR_year=2011", "long/father/FAR_year=2011", "analytical_data/longitudinal/income/ind/year=2011"} <= changed
    assert not any("2010" in k or "2012" in k or k.startswith(("panels/akm", "panels/bef", "long/child", "population")) for k in changed)
    fresh = whole(study, copy, f"{folder}/fresh")
    assert c.build_study(spark, fresh)
    same_rows(spark, one.output, fresh.output, [*TABLES, "events", "cohort", "analytical_data/derived/statistics/longitudinal/income"])


def test_what_a_change_touches(spark, copy, folder):
    """Years of files that are new, changed or gone; everything where a year has lost its last file."""
    base, manifest = f"{folder}/ind", f"{folder}/manifest"
    shutil.copytree(f"{copy}/ind", base)
    look = lambda: find_change(spark, "ind", f"{base}/*.parquet", manifest)
    assert look() == Change() and (mark_done(spark, "ind", manifest) or look()) is None
    shutil.copytree(f"{base}/ind2012.parquet", f"{base}/ind201307.parquet")
    shutil.copytree(f"{base}/ind2012.parquet", f"{base}/ind201308.parquet")
    change = look()
    assert change.years == {2013} and len(change.files) == 2 and all("ind20130" in f for f in change.files)
    mark_done(spark, "ind", manifest)
    replace(spark, folder, "ind/ind201308.parquet", lambda df: df.limit(3))
    change = look()
    assert change.years == {2013} and {f.split("/")[-2] for f in change.files} == {"ind201307.parquet", "ind201308.parquet"}
    mark_done(spark, "ind", manifest)
    shutil.move(f"{base}/ind201307.parquet", f"{folder}/away7.parquet")
    change = look()
    assert change.years == {2013} and len(change.files) == 1
    mark_done(spark, "ind", manifest)
    shutil.move(f"{base}/ind201308.parquet", f"{folder}/away8.parquet")
    assert look() == Change()


def test_changed_population_rebuilds_roles(spark, study, copy, folder):
    one = whole(study, copy, f"{folder}/one")
    assert c.build_study(spark, one)
    before = files(one.output, *TABLES)
    replace(spark, copy, "bef/bef_201112.parquet", lambda df: df.withColumn("KOM", F.col("KOM") + 1))
    assert c.build_study(spark, one)  # the same people: one year only
    changed = {k for k, v in files(one.output, *TABLES).items() if before.get(k) != v}
    assert "long/child/year=2011" in changed and "panels/bef/year=2011" in changed and not {"long/child/year=2010", "long/mother/MOR_year=2010"} & changed
    replace(spark, copy, "mfr/mfr.parquet", lambda df: df.withColumn("FOEDSELSDATO", F.lit("2003-03-04")))
    assert c.build_study(spark, one)
    changed = {k for k, v in files(one.output, *TABLES).items() if before.get(k) != v}
    assert {"long/child/year=2010", "long/mother/MOR_year=2010", "population"} <= changed


def test_unreadable_register_is_left_out(spark, study, copy, folder):
    base = f"{folder}/in"
    shutil.copytree(copy, base)
    good = glob.glob(f"{base}/akm/akm2011.parquet/part-*.parquet")[0]
    with open(good, "rb") as f:
        content = f.read()
    with open(good, "wb") as f:
        f.write(b"no table at all")
    one = whole(study, base, f"{folder}/one")
    assert c.build_study(spark, one)
    outcomes = {r["register"]: (r["outcome"], r["error"]) for r in spark.read.parquet(f"{one.output}/outcomes").collect()}
    assert outcomes["akm"][0] == "failed" and outcomes["akm"][1] and outcomes["ind"] == ("written", None)
    assert spark.read.json(f"{one.output}/analytical_data/catalogue").filter("kind = 'register' and name = 'akm'").count() == 1
    assert read_panel(spark, f"{one.output}/panels/ind").count() and not glob.glob(f"{one.output}/panels/akm/year=*")
    with open(good, "wb") as f:
        f.write(content)
    assert c.build_study(spark, one)
    assert spark.read.parquet(f"{one.output}/outcomes").select("register", "outcome").collect() == [("akm", "written")]
    assert read_panel(spark, f"{one.output}/panels/akm").count() == 165 and not c.build_study(spark, one)
    assert read_panel(spark, f"{one.output}/long/mother").filter("register = 'akm'").count() > 0


def test_prepared_register(spark, study, folder):
    only = c.Study({"bef": study.registers["bef"], "ind": study.registers["ind"]}, f"{folder}/out", 2000, 2004, prepare={"ind": lambda df: df.filter("year > 2010").withColumn("PERINDKIALT_13", F.lit(1.0))})
    panels = c.build_panels(spark, only)
    assert {tuple(r) for r in panels["ind"].select("year", "PERINDKIALT_13").distinct().collect()} == {(2011, 1.0), (2012, 1.0)}
    c.write_baseline(panels["bef"], f"{folder}/by_sex", stratify_by="KOEN")
