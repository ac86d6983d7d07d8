"""Report tables: distributions at study years and the baseline table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.fixed_values import BASELINE_AGES, BASELINE_CATEGORIES, BASELINE_INCLUSION_AGE, BASELINE_NUMBERS, STUDY_YEARS
from kinpanel.functions.dates import years_between
from kinpanel.functions.text import count_share, mean_median, percent
from kinpanel.operators.statistics import numeric_statistics

ALL = "all"


def distribution(df: DataFrame, column: str, years: list[int] | None = None, person: str = "PNR") -> DataFrame:
    """Rows per value and their percentage of distinct persons, most frequent first; per study year if given."""
    persons = df.agg(F.count_distinct(person).alias("n")).scalar()
    by = [] if years is None else ["year"]
    rows = df if years is None else df.where(F.col("year").isin(years))
    return (
        rows.groupBy(*by, F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("count"))
        .withColumn("percentage", F.col("count") / persons * 100)
        .orderBy(*by, F.desc("count"), "value")
    )


def _numeric_items(df: DataFrame, reference: Column | None) -> list[tuple[str, str, bool, Column, int]]:
    """(section, variable, per study year, value, decimals) for the columns the panel has."""
    has = set(df.columns).__contains__
    items = []
    if has("FOED_DAG") and reference is not None:
        items.append((*BASELINE_INCLUSION_AGE, False, years_between(reference, F.col("FOED_DAG")), 1))
    for section, variable, birth in BASELINE_AGES:
        if has("FOED_DAG") and has(birth):
            items.append((section, variable, False, years_between("FOED_DAG", birth), 1))
    for section, variable, yearly, column, decimals in BASELINE_NUMBERS:
        if has(column):
            items.append((section, variable, yearly, F.col(column).cast("double"), decimals))
    return items


def _category_items(df: DataFrame) -> list[tuple[str, str, bool, str]]:
    return [i for i in BASELINE_CATEGORIES if i[3] in df.columns]


def _cells(df: DataFrame, items: list[tuple[str, str, bool, Column]], years: list[int], stratum: Column) -> DataFrame:
    """One row per panel row and item: item (``v0``, ``v1``, ...), period (null for all years), stratum, value."""
    names = [f"v{i}" for i in range(len(items))]
    wide = df.select(F.col("year").cast("int").alias("year"), stratum.alias("stratum"), *[i[3].alias(n) for i, n in zip(items, names)])
    long = wide.unpivot(["year", "stratum"], names, "item", "value")
    yearly = F.col("item").isin([n for i, n in zip(items, names) if i[2]])
    kept = long.where(~yearly | F.col("year").isin(years))
    return kept.select("item", F.when(yearly, F.col("year")).alias("period"), "stratum", "value")


def _named(items: list[tuple], position: int) -> Column:
    """Text at ``position`` of the item a row belongs to."""
    expr = F.lit(None).cast("string")
    for i, item in enumerate(items):
        expr = F.when(F.col("item") == f"v{i}", item[position]).otherwise(expr)
    return expr


def baseline_table(
    df: DataFrame, study_years: list[int] | None = None, stratify_by: str | None = None, reference_date: Column | str | None = None
) -> DataFrame:
    """Baseline characteristics of children, mothers, fathers and families from a person-year panel.

    Long and numeric: one row per variable, study year (null where it does not
    apply), stratum and, for distributions, value.  ``n`` counts values,
    ``missing_pct`` and ``percentage`` refer to all distinct persons.  Numeric
    variables are given per stratum, rows without a stratum left out.
    """
    years = study_years or STUDY_YEARS
    reference = F.lit(reference_date).cast("date") if isinstance(reference_date, str) else reference_date
    persons = df.agg(F.count_distinct("PNR").alias("n")).scalar()
    doubles = ["mean", "std", "median", "q1", "q3"]
    none = {c: F.lit(None).cast("double").alias(c) for c in (*doubles, "percentage", "missing_pct")}
    columns = ["category", "variable", "period", "stratum", "value", "n", *doubles, "percentage", "missing", "missing_pct"]

    parts = [
        df.agg(F.count_distinct("PNR").alias("n")).select(
            F.lit(BASELINE_INCLUSION_AGE[0]).alias("category"),
            F.lit("Total children").alias("variable"),
            F.lit(None).cast("int").alias("period"),
            F.lit(ALL).alias("stratum"),
            F.lit(None).cast("string").alias("value"),
            "n",
            *[none[c] for c in (*doubles, "percentage")],
            F.lit(0).cast("bigint").alias("missing"),
            F.lit(0.0).alias("missing_pct"),
        )
    ]
    numeric = _numeric_items(df, reference)
    if numeric:
        rows = df if stratify_by is None else df.where(F.col(stratify_by).isNotNull())
        stratum = F.lit(ALL) if stratify_by is None else F.col(stratify_by).cast("string")
        cells = _cells(rows, [i[:4] for i in numeric], years, stratum)
        stats = numeric_statistics(cells, ["value"], ["item", "period", "stratum"])
        parts.append(
            stats.select(
                _named(numeric, 0).alias("category"),
                _named(numeric, 1).alias("variable"),
                "period",
                "stratum",
                F.lit(None).cast("string").alias("value"),
                F.col("count").alias("n"),
                *doubles,
                none["percentage"],
                "missing",
                (F.col("missing") / persons * 100).alias("missing_pct"),
            )
        )
    categories = _category_items(df)
    if categories:
        items = [(s, v, y, F.col(c).cast("string")) for s, v, y, c in categories]
        counts = _cells(df, items, years, F.lit(ALL)).groupBy("item", "period", "stratum", "value").agg(F.count("*").alias("n"))
        missing = F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0).cast("bigint"))
        parts.append(
            counts.select(
                _named(items, 0).alias("category"), _named(items, 1).alias("variable"), "period", "stratum", "value", "n",
                *[none[c] for c in doubles],
                (F.col("n") / persons * 100).alias("percentage"),
                missing.alias("missing"),
                (missing / persons * 100).alias("missing_pct"),
            )
        )
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def baseline_text(table: DataFrame) -> DataFrame:
    """The baseline table as text: Category, Variable, Value, Missing, Year, ready for a CSV file."""
    stratum = F.when(F.col("stratum") != ALL, F.concat(F.lit(" - "), F.col("stratum"))).otherwise("")
    level = F.when(F.col("percentage").isNotNull(), F.concat(F.lit(": "), F.coalesce("value", F.lit("missing")))).otherwise("")
    measures = [F.col(c) for c in ("mean", "std", "median", "q1", "q3")]
    whole = F.col("variable").endswith("(DKK)")
    value = (
        F.when(F.col("percentage").isNotNull(), count_share(F.col("n"), F.col("percentage")))
        .when(F.col("variable") == "Total children", F.format_number("n", 0))
        .when(whole, mean_median(*measures, decimals=0))
        .otherwise(mean_median(*measures))
    )
    return table.select(
        F.col("category").alias("Category"),
        F.concat(F.col("variable"), level, stratum).alias("Variable"),
        value.alias("Value"),
        percent(F.col("missing_pct")).alias("Missing"),
        F.coalesce(F.col("period").cast("string"), F.lit("All")).alias("Year"),
    )


