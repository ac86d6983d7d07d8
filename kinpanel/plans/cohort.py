"""The cohort job from register files to the analytical dataset, and its report files."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinpanel.fixed_values import FIRST_BIRTH_YEAR, LAST_BIRTH_YEAR
from kinpanel.operators import event_reports as er
from kinpanel.operators import health as h
from kinpanel.operators import population as p
from kinpanel.operators import statistics as st
from kinpanel.operators.events import EVENTS, Event, identify_events
from kinpanel.operators.panel import PERSON, add_education_level, join_parent, join_register, label_codes, split_roles, stack_registers
from kinpanel.operators.tables import baseline_table, baseline_text
from kinpanel.plans.zones import write_domains, write_health, write_people, write_zones
from kinpanel.sources.buckets import read_bucketed, write_bucketed
from kinpanel.sources.dictionaries import read_json_dictionary
from kinpanel.sources.manifest import Change, catalogue, find_change, is_changed, mark_done, read_manifest, write_catalogue
from kinpanel.sources.registers import read_births, read_parquet, read_population, read_register
from kinpanel.sources.sketches import profile_panel, stored_hot_keys, write_key_sketches, write_sketches
from kinpanel.sources.tables import check_partitions, exists, of_years, partition_rows, read_panel, row_marks, write_listing, write_observed, write_panel, write_report, write_table

log = logging.getLogger(__name__)

YEARLY = ("bef", "uddf", "ind", "akm", "idan")
#: Name of the folder of rows without a year.
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"
HOSPITAL = ("lpr_adm", "lpr_diag", "lpr_bes", "lpr3_kontakter", "lpr3_diagnoser")


@dataclass
class Study:
    """Paths by register name, the output folder, and the choices of a run."""

    registers: dict[str, str]
    output: str
    first_birth_year: int = FIRST_BIRTH_YEAR
    last_birth_year: int = LAST_BIRTH_YEAR
    scd_mode: str = "category"
    with_labels: bool = False
    #: By column in small letters: a table of ``code`` and ``label``, or the path of a JSON dictionary, as of citizenship (``statsb``).
    dictionaries: dict[str, DataFrame | str] = field(default_factory=dict)
    education_levels: DataFrame | None = None
    #: Write population and panels in so many buckets by person (see ``sources.buckets``), so that role joins move the population only.
    buckets: int | None = None
    #: By register: applied to the rows of its files before columns are kept and typed.
    prepare: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def build_population(spark: SparkSession, study: Study) -> DataFrame:
    """Children of the inclusion years with their parents' birth dates, and the two summaries.

    Marks of the rows and of the persons are taken while they are written and kept beside the manifest."""
    register = read_population(spark, study.registers["bef"])
    births = read_births(spark, study.registers["mfr"]) if "mfr" in study.registers else None
    years = (study.first_birth_year, study.last_birth_year)
    bef = p.unique_children(register, *years)
    mfr = None if births is None else p.unique_children(births, *years)
    # Written once: the lookups and both summaries read it.
    write_table(p.combine_children(bef, mfr), f"{study.output}/children")
    children = spark.read.parquet(f"{study.output}/children")
    population = p.add_parent_births(children, p.parent_births(register))
    marks = {**_named("rows", row_marks(*population.columns)), **_named("people", row_marks("PNR"))}
    path = f"{study.output}/population"
    if study.buckets:
        seen = Observation()
        write_bucketed(population, path, buckets=study.buckets, year=None, observe=lambda df: df.observe(seen, *[c.alias(n) for n, c in marks.items()]))
        told = seen.get
    else:
        told = write_observed(population, path, marks)
    write_key_sketches(spark, path, ["PNR", "FAR_ID", "MOR_ID"], year=None)
    _remember(spark, study, "population", told)
    write_table(p.summary_before(bef, mfr), f"{study.output}/population_summary_before")
    write_table(p.summary_after(children), f"{study.output}/population_summary_after")
    return _open(spark, study, f"{study.output}/population", spark.read.parquet)


def _named(prefix: str, measures: dict[str, object]) -> dict[str, object]:
    return {f"{prefix}_{k}": v for k, v in measures.items()}


def _part(prefix: str, told: dict[str, object]) -> dict[str, object]:
    return {k.removeprefix(f"{prefix}_"): v for k, v in told.items() if k.startswith(f"{prefix}_")}


def _remember(spark: SparkSession, study: Study, table: str, told: dict[str, object]) -> None:
    """Keep a table's measures as text; ``_told`` gives them back."""
    rows = [(k, str(v)) for k, v in sorted(told.items())]
    spark.createDataFrame(rows, "measure string, value string").coalesce(1).write.mode("overwrite").parquet(f"{study.output}/manifest/{table}")


def _told(spark: SparkSession, study: Study, table: str) -> dict[str, str]:
    found = read_manifest(spark, f"{study.output}/manifest/{table}")
    return {} if found is None else {r["measure"]: r["value"] for r in found.collect()}


def _open(spark: SparkSession, study: Study, path: str, read: Callable[[str], DataFrame]) -> DataFrame:
    return read_bucketed(spark, path) if study.buckets else read(path)


def build_care(spark: SparkSession, study: Study) -> DataFrame | None:
    """One row per hospital contact of both systems, written once; None when a register is not given."""
    if not all(r in study.registers for r in HOSPITAL):
        return None
    parts = [read_parquet(spark, study.registers[r]) for r in HOSPITAL]
    write_table(h.care_of_both(*parts, mode=study.scd_mode), f"{study.output}/care")
    return spark.read.parquet(f"{study.output}/care")


def build_health(spark: SparkSession, study: Study) -> DataFrame | None:
    """Harmonised records, every combination of a contact's diagnoses and visits, for callers that want them."""
    if not all(r in study.registers for r in HOSPITAL):
        return None
    parts = [read_parquet(spark, study.registers[r]) for r in HOSPITAL]
    write_table(h.health_data(*parts), f"{study.output}/health")
    return spark.read.parquet(f"{study.output}/health")


def build_panels(spark: SparkSession, study: Study, changes: dict[str, Change] | None = None, failed: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Yearly panels of the registers given, written partitioned by year.

    ``changes``: the registers to write, and of each the years; others stay as they are. With ``failed``, a register that cannot be
    read or written is left out, its error noted there under its name; without it the error ends the job.
    """
    panels = {}
    for name in YEARLY:
        if name not in study.registers:
            continue
        path = f"{study.output}/panels/{name}"
        try:
            if changes is None or name in changes:
                years = _write_register(spark, study, name, path, Change() if changes is None else changes[name])
                write_sketches(spark, path, years)
                write_key_sketches(spark, path, ["PNR"], years)
            panels[name] = _open(spark, study, path, lambda p: read_panel(spark, p))
        except (PySparkException, Py4JJavaError, ValueError) as e:
            if failed is None:
                raise
            failed.setdefault(name, f"{type(e).__name__}: {e}".split("\n", 1)[0][:500])
            log.warning("register %s is left out: %s", name, failed[name])
            if exists(spark, path):  # as it was
                panels[name] = _open(spark, study, path, lambda p: read_panel(spark, p))
    return panels


def _write_register(spark: SparkSession, study: Study, name: str, path: str, change: Change) -> frozenset[int] | None:
    """Returns the years written, None for all."""
    prepare = study.prepare.get(name)
    partial = change.years is not None and exists(spark, path)
    df = read_register(spark, name, list(change.files) if partial else study.registers[name], prepare=prepare)
    if study.with_labels:
        given = {k: read_json_dictionary(spark, d) if isinstance(d, str) else d for k, d in study.dictionaries.items()}
        df = label_codes(df, name, given)
    if name == "uddf" and study.education_levels is not None:
        df = add_education_level(df, study.education_levels)
    if study.buckets:
        write_bucketed(of_years(df, change.years) if partial else df, path, buckets=study.buckets, only_given=partial)
        return change.years if partial else None
    if partial:
        write_panel(of_years(df, change.years), path, only_given=True)
        return change.years
    # Written beside it first: a register that fails half-way leaves the panel it had.
    if exists(spark, path):
        write_panel(df, f"{path}_new")
        df = read_panel(spark, f"{path}_new")
    write_panel(df, path)
    return None


ROLE_OF = {"bef": ("child",)}
PARENTS = ("mother", "father")


def _role_frames(spark: SparkSession, study: Study, population: DataFrame, panels: dict[str, DataFrame], role: str, years: frozenset[int] | None) -> dict[str, DataFrame]:
    """Rows of one role by register. With ``years``: those of these years, and those of people without any row.

    Heavy keys are known from the sketches beside the tables; no scan looks for them."""
    out, key = {}, {"child": "PNR", "mother": "MOR_ID", "father": "FAR_ID"}[role]
    heavy = stored_hot_keys(spark, f"{study.output}/population", key, with_null=True)
    for name, panel in panels.items():
        if role not in ROLE_OF.get(name, PARENTS):
            continue
        own = panel.drop("FOED_DAG", "FAR_ID", "MOR_ID", "FAMILIE_ID") if role == "child" else panel
        known = {"left_hot": heavy, "right_hot": stored_hot_keys(spark, f"{study.output}/panels/{name}", "PNR")}
        join = (lambda a, b, known=known: join_register(a, b, **known)) if role == "child" else (lambda a, b, known=known: join_parent(a, b, role, **known))
        if years is None:
            out[name] = join(population, own)
            continue
        year = PERSON[role][0]
        some = join(population, of_years(own, years)).where(F.col(year).isNotNull())
        there = panel.select(F.col("PNR").alias("__known")).distinct()
        none = population.where(F.col(key).isNotNull()).join(there, F.col(key) == F.col("__known"), "left_anti")
        none = none.unionByName(population.where(F.col(key).isNull()))
        out[name] = some.unionByName(none, allowMissingColumns=True).select(*some.columns)
    return out


def build_role_panels(
    spark: SparkSession, study: Study, population: DataFrame, panels: dict[str, DataFrame], years: dict[str, frozenset[int] | None] | None = None
) -> dict[str, DataFrame]:
    """Panels of child, mother and father: own rows from BEF, parents' rows from the other registers.

    Each role has a plan of its own, so the rows of one parent are never multiplied by those of the other, and is
    written by year; years without rows between the first and the last are logged. ``years``: the registers that changed
    and the years of each (None for all); a role is written only for the years of its registers, from the panels' folders of these
    years. The population must be the same as before then.
    """
    out = {}
    for role, (year, person) in PERSON.items():
        sources = [n for n in panels if role in ROLE_OF.get(n, PARENTS)]
        if not sources:
            continue
        path = f"{study.output}/long/{role}"
        touched = None if years is None else [years[n] for n in sources if n in years]
        if touched is None or None in touched or not exists(spark, path):
            _write_role(spark, study, population, panels, role, path)
        elif touched and not _write_role_years(spark, study, population, panels, role, path, frozenset().union(*touched)):
            _write_role(spark, study, population, panels, role, path)
        out[role] = read_panel(spark, path)
        gaps = [r[0] for r in check_partitions(spark, path, year).collect()]
        if gaps:
            log.warning("%s panel has no rows in %s", role, gaps)
    return out


def _write_role(spark: SparkSession, study: Study, population: DataFrame, panels: dict[str, DataFrame], role: str, path: str) -> None:
    year, person = PERSON[role]
    write_panel(split_roles(stack_registers(_role_frames(spark, study, population, panels, role, None)))[role], path, year, [person])


def _write_role_years(spark: SparkSession, study: Study, population: DataFrame, panels: dict[str, DataFrame], role: str, path: str, years: frozenset[int]) -> bool:
    """Replace some years of a role's panel. False, and nothing replaced, where a folder would have to go."""
    year, person = PERSON[role]
    df = split_roles(stack_registers(_role_frames(spark, study, population, panels, role, years)))[role]
    write_panel(df, f"{path}_years", year, [person])
    folders = lambda p: {r[0] for r in partition_rows(spark, p, year).select(year).collect()}
    given, before = folders(f"{path}_years"), folders(path)
    if (before & ({str(y) for y in years} | {NO_YEAR})) - given:
        return False
    write_panel(read_panel(spark, f"{path}_years"), path, year, [person], only_given=True)
    return True


def build_cohort(spark: SparkSession, study: Study) -> DataFrame:
    """Population, care, panels and zones; returns the population with disease flags."""
    population = build_population(spark, study)
    care = build_care(spark, study)
    panels = build_panels(spark, study)
    cohort = population if care is None else h.add_flags(population, h.care_flags(care))
    write_table(cohort, f"{study.output}/cohort")
    write_zones(spark, f"{study.output}/analytical_data", population, panels, care)
    return spark.read.parquet(f"{study.output}/cohort")


def build_study(spark: SparkSession, study: Study, categories: list[str] | None = None) -> bool:
    """The whole study from register files to reports, if a file of any register is new, changed or gone.

    Returns whether it ran. ``categories`` are columns of the panels carried along events into the category reports.

    Only what depends on the changed files is built again: of a yearly register the years that they have rows of, in its panel, its
    domain and the panels of its roles; the population if its registers changed, and the role panels as a whole only if its
    rows did; care and flags if a hospital register changed. Events and reports look across years and are made anew.

    A yearly register that cannot be read is left out (its former panel stays, if there is one), so are the hospital registers together;
    ``{output}/outcomes`` and the catalogue say so, and the next run tries again. The population needs its register.
    """
    out, manifest, failed = study.output, f"{study.output}/manifest", {}
    changes = {name: _change(spark, study, name, failed) for name in study.registers}
    changes = {name: c for name, c in changes.items() if c is not None}
    if not changes:
        return False
    log.info("changed registers: %s", ", ".join(changes))
    population, same = _population(spark, study, bool(changes.keys() & {"bef", "mfr"}))
    care, new_care = _care(spark, study, bool(changes.keys() & set(HOSPITAL)), failed)
    yearly = {n: c for n, c in changes.items() if n in YEARLY}
    panels = build_panels(spark, study, yearly, failed)
    years = {n: c.years for n, c in yearly.items() if n not in failed}
    if not same or new_care or not exists(spark, f"{out}/cohort"):
        _write_cohort(spark, study, population, care)
    base = f"{out}/analytical_data"
    if not same or not exists(spark, f"{base}/static"):
        write_people(spark, base, population)
    write_domains(spark, base, panels, years=years)
    if care is not None and (new_care or not exists(spark, f"{base}/longitudinal/health")):
        write_health(base, care)
    roles = build_role_panels(spark, study, population, panels, years if same else None)
    _write_reports(spark, study, population, roles, categories)
    outcomes = spark.createDataFrame([(n, "failed" if n in failed else "written", failed.get(n)) for n in changes], "register string, outcome string, error string")
    write_table(outcomes.withColumn("at", F.current_timestamp()), f"{out}/outcomes")
    told = spark.createDataFrame([("register", n, f"left out: {e}") for n, e in failed.items()], "kind string, name string, description string")
    write_catalogue(catalogue(spark).unionByName(told, allowMissingColumns=True), f"{base}/catalogue")
    for name in changes:
        if name not in failed:
            mark_done(spark, name, manifest)
    return True


def _change(spark: SparkSession, study: Study, name: str, failed: dict[str, str]) -> Change | None:
    """What changed of a register; of the registers of the population and of the hospital whether anything did."""
    path, manifest = study.registers[name], f"{study.output}/manifest"
    try:
        if name in YEARLY:
            return find_change(spark, name, path, manifest)
        return Change() if is_changed(spark, name, path, manifest) else None
    except (PySparkException, Py4JJavaError, ValueError) as e:
        if name == "bef":
            raise
        failed[name] = f"{type(e).__name__}: {e}".split("\n", 1)[0][:500]
        log.warning("register %s cannot be read: %s", name, failed[name])
        return Change()


def _population(spark: SparkSession, study: Study, changed: bool) -> tuple[DataFrame, bool]:
    """The population, built again if its registers changed, and whether it has the same rows as before."""
    path = f"{study.output}/population"
    if not changed and exists(spark, path):
        return _open(spark, study, path, spark.read.parquet), True
    before = _part("rows", _told(spark, study, "population"))
    population = build_population(spark, study)
    return population, before == _part("rows", _told(spark, study, "population"))


def _write_cohort(spark: SparkSession, study: Study, population: DataFrame, care: DataFrame | None) -> None:
    """Population with disease flags. The writing tasks count persons and cases; nobody may be lost or doubled on the way."""
    cohort = population if care is None else h.add_flags(population, h.care_flags(care))
    marks = _named("people", row_marks("PNR")) | ({} if care is None else _named("scd", h.summary_measures()))
    told = write_observed(cohort, f"{study.output}/cohort", marks)
    h.check_same_people(_part("people", _told(spark, study, "population")), {k: str(v) for k, v in _part("people", told).items()})
    _remember(spark, study, "cohort", told)


def _care(spark: SparkSession, study: Study, changed: bool, failed: dict[str, str]) -> tuple[DataFrame | None, bool]:
    """Contacts of both hospital systems, built again if one of their registers changed, and whether they were."""
    path = f"{study.output}/care"
    if not changed and exists(spark, path):
        return spark.read.parquet(path), False
    try:
        care = build_care(spark, study)
        return care, care is not None
    except (PySparkException, Py4JJavaError, ValueError) as e:
        message = f"{type(e).__name__}: {e}".split("\n", 1)[0][:500]
        failed.update({n: failed.get(n, message) for n in HOSPITAL})
        log.warning("hospital registers are left out: %s", message)
        return (spark.read.parquet(path), False) if exists(spark, path) else (None, False)


def _write_reports(spark: SparkSession, study: Study, population: DataFrame, roles: dict[str, DataFrame], categories: list[str] | None) -> None:
    events, reports = build_events(spark, study, roles, keep=categories), f"{study.output}/reports"
    summary = _part("scd", _told(spark, study, "cohort"))
    if summary:
        one = spark.createDataFrame([tuple(int(summary[k]) for k in h.summary_measures())], [*h.summary_measures()])
        write_report(one, f"{reports}/scd_summary")
        write_report(h.prevalence_of(F.col("total_patients"), F.col("scd_positive"), one), f"{reports}/scd")
    for name in YEARLY:
        if exists(spark, f"{study.output}/panels/{name}_sketches"):
            write_report(profile_panel(spark, f"{study.output}/panels/{name}"), f"{reports}/profiles/{name}")
    write_population_reports(population, f"{reports}/population")
    write_event_reports(events, f"{reports}/events")
    write_event_figures(events, f"{reports}/figures", [c for c in categories or [] if c in events.columns])
    if "child" in roles:
        write_baseline(roles["child"], f"{reports}/baseline")
        if "KOEN" in roles["child"].columns:
            write_baseline(roles["child"], f"{reports}/baseline_by_sex", stratify_by="KOEN")


def build_events(
    spark: SparkSession, study: Study, role_panels: dict[str, DataFrame], definitions: dict[str, dict[str, Event]] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Events of all roles, written once."""
    found = [identify_events(df, (definitions or EVENTS).get(role, {}), role, keep, within=["register"]) for role, df in role_panels.items()]
    write_table(stack_registers(found), f"{study.output}/events")
    return spark.read.parquet(f"{study.output}/events")


def write_baseline(panel: DataFrame, path: str, **choices) -> None:
    write_report(baseline_text(baseline_table(panel, **choices)), path)


def write_population_reports(family: DataFrame, path: str) -> None:
    write_report(st.describe(family), f"{path}/basic_stats")
    write_report(st.missing_table(family), f"{path}/missing_data")
    write_listing(p.birth_dates(family), f"{path}/child_age_distribution")
    write_listing(p.age_gaps(family), f"{path}/parent_child_age_diff")


def write_event_reports(events: DataFrame, path: str) -> None:
    write_report(er.event_counts(events), f"{path}/event_counts")
    write_report(er.event_timing(events), f"{path}/event_timing")
    write_listing(er.event_dates(events), f"{path}/event_distribution")
    write_report(er.event_counts(events, ordered=True), f"{path}/event_proportions")


def write_event_figures(events: DataFrame, path: str, categories: list[str] | None = None, top_n: int = 5, min_count: int = 10) -> None:
    """Data behind the event figures: matrix, correlation, shares, flows and time to event."""
    write_report(er.count_long(events), f"{path}/event_occurrences")
    write_report(er.event_correlation(events), f"{path}/event_correlation")
    write_report(er.event_share(events, "year"), f"{path}/event_distribution_year")
    for c in categories or []:
        write_report(er.count_long(events, "year", c), f"{path}/{c}_distribution")
        write_report(er.event_share(events, "year", c), f"{path}/{c}_distribution_year")
    write_listing(er.event_flows(events, top_n, min_count, aggregate=False), f"{path}/flows")
    er.time_to_event(events).write.mode("overwrite").option("header", True).partitionBy("event_type").csv(f"{path}/survival_data")


def write_scd_report(flags: DataFrame, path: str) -> None:
    write_report(h.prevalence(flags), path)
