"""The analytical dataset: static, longitudinal, family and derived zones with their statistics."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from kinpanel.fixed_values import DOMAIN_NAMES, DOMAIN_SOURCES, DOMAIN_STATISTICS
from kinpanel.operators.columns import rename_known
from kinpanel.operators.health import care_groups, person_year_care
from kinpanel.operators.population import family_size, individuals, relationships
from kinpanel.operators.statistics import table_statistics
from kinpanel.sources.manifest import catalogue, write_catalogue
from kinpanel.sources.tables import of_years, read_panel, write_panel, write_table

log = logging.getLogger(__name__)


def domain_panel(panel: DataFrame) -> DataFrame:
    """Register columns under the names the domain statistics use."""
    return rename_known(panel, {k: v for k, v in DOMAIN_NAMES.items() if v not in panel.columns})


def domain_statistics(panel: DataFrame, columns: dict[str, list[str]]) -> DataFrame | None:
    """Statistics per year and column; None when the panel has no year or none of the columns."""
    numeric, categorical, temporal = ([c for c in columns.get(k, []) if c in panel.columns] for k in ("numeric", "categorical", "temporal"))
    if "year" not in panel.columns or not (numeric or categorical or temporal):
        return None
    return table_statistics(panel, numeric, categorical, temporal, by=["year"])


def static_statistics(people: DataFrame) -> DataFrame:
    return table_statistics(people, ["age"], ["sex", "role"], ["birth_date"])


def family_statistics(families: DataFrame) -> DataFrame:
    return table_statistics(
        families, ["household_size", "number_of_children"], ["family_type"], ["father_birth_date", "mother_birth_date"]
    )


def write_domains(spark: SparkSession, base: str, panels: dict[str, DataFrame], statistics: dict[str, dict[str, list[str]]] | None = None, years: dict[str, frozenset[int] | None] | None = None) -> None:
    """The longitudinal zone and its statistics by year. ``years``: the registers to write and the years of each, all of them if None."""
    domains = statistics or DOMAIN_STATISTICS
    for domain, source in DOMAIN_SOURCES.items():
        if source not in panels or years is not None and source not in years:
            continue
        panel, some = domain_panel(panels[source]), None if years is None else years[source]
        if "year" not in panel.columns:
            log.warning("%s has no year column and is left out", source)
            continue
        path = f"{base}/longitudinal/{domain}/{source}"
        written = lambda df, some=some: df if some is None else of_years(df, some)
        write_panel(written(panel), path, only_given=some is not None)
        stats = domain_statistics(written(read_panel(spark, path)), domains.get(domain, {}))
        if stats is not None:
            write_table(stats, f"{base}/derived/statistics/longitudinal/{domain}", partition_by="year", only_given=some is not None)


def write_people(spark: SparkSession, base: str, population: DataFrame) -> None:
    """Static and family zones with their statistics."""
    write_table(individuals(population), f"{base}/static/individual_attributes")
    write_table(relationships(population), f"{base}/family/family_relationships")
    families = spark.read.parquet(f"{base}/family/family_relationships")
    write_table(family_size(families), f"{base}/derived/family_statistics")
    write_table(static_statistics(spark.read.parquet(f"{base}/static/individual_attributes")), f"{base}/derived/statistics/static")
    write_table(family_statistics(families), f"{base}/derived/statistics/family")


def write_health(base: str, care: DataFrame) -> None:
    write_panel(person_year_care(care), f"{base}/longitudinal/health/health_summary")
    write_panel(care_groups(care), f"{base}/longitudinal/health/diagnosis_groups")


def write_zones(
    spark: SparkSession,
    base: str,
    population: DataFrame,
    panels: dict[str, DataFrame],
    care: DataFrame | None = None,
    statistics: dict[str, dict[str, list[str]]] | None = None,
) -> None:
    """Write every zone under ``base``; statistics are computed from the tables just written. ``care``: one row per contact."""
    write_people(spark, base, population)
    write_domains(spark, base, panels, statistics)
    if care is not None:
        write_health(base, care)
    write_catalogue(catalogue(spark), f"{base}/catalogue")
