"""Study population: children, their parents, and the counts around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.fixed_values import FIRST_BIRTH_YEAR, LAST_BIRTH_YEAR
from kinpanel.functions.dates import years_between
from kinpanel.operators.columns import require
from kinpanel.operators.scale import HOT_ROWS, hot_keys, left_join

CHILD = ["PNR", "FOED_DAG", "FAR_ID", "MOR_ID", "FAMILIE_ID"]
FAMILY = ["PNR", "FOED_DAG", "FAR_ID", "FAR_FDAG", "MOR_ID", "MOR_FDAG", "FAMILIE_ID"]


def born_between(df: DataFrame, first: int = FIRST_BIRTH_YEAR, last: int = LAST_BIRTH_YEAR, date: str = "FOED_DAG") -> DataFrame:
    """Births in the years ``first`` to ``last``, as date bounds so that the scan can skip row groups."""
    return df.where((F.col(date) >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (F.col(date) < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))))


def first_record(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The person's earliest row: lowest ``order``, then lowest values; nulls first.

    A minimum over structs, so rows are combined map-side and no person's rows
    are gathered.
    """
    rest = [c for c in columns if c != key]
    order = [c for c in order if c in df.columns]
    ranked = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    first = df.groupBy(key).agg(F.min(F.struct(*ranked, *rest)).alias("__first"))
    return first.select(*[F.col(key) if c == key else F.col(f"__first.{c}").alias(c) for c in columns])


def unique_children(df: DataFrame, first: int = FIRST_BIRTH_YEAR, last: int = LAST_BIRTH_YEAR) -> DataFrame:
    """One row per child born in the inclusion years."""
    require(df, CHILD)
    return first_record(born_between(df, first, last), "PNR", CHILD, ["year", "month"])


def parent_births(df: DataFrame) -> DataFrame:
    """One birth date per person of the population register."""
    require(df, ["PNR", "FOED_DAG"])
    return first_record(df, "PNR", ["PNR", "FOED_DAG"], ["year", "month"])


def combine_children(register: DataFrame, births: DataFrame | None) -> DataFrame:
    """Children of either source; the population register wins, family ids come from it alone.

    ``in_register`` and ``in_births`` tell where a child was found.
    """
    if births is None:
        return register.select(*CHILD, F.lit(True).alias("in_register"), F.lit(False).alias("in_births"))
    r = register.select(*CHILD, F.lit(True).alias("in_register"))
    b = births.select("PNR", *[F.col(c).alias(f"__b_{c}") for c in ("FOED_DAG", "FAR_ID", "MOR_ID")], F.lit(True).alias("in_births"))
    joined = r.join(b, "PNR", "full")

    def either(c: str) -> Column:
        return F.coalesce(c, f"__b_{c}").alias(c)

    return joined.select(
        "PNR",
        either("FOED_DAG"),
        either("FAR_ID"),
        either("MOR_ID"),
        "FAMILIE_ID",
        F.coalesce("in_register", F.lit(False)).alias("in_register"),
        F.coalesce("in_births", F.lit(False)).alias("in_births"),
    )


def add_parent_births(children: DataFrame, parents: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Birth dates of father and mother looked up by id; a parent of very many children is spread."""
    fathers = parents.select(F.col("PNR").alias("__father"), F.col("FOED_DAG").alias("FAR_FDAG"))
    mothers = parents.select(F.col("PNR").alias("__mother"), F.col("FOED_DAG").alias("MOR_FDAG"))
    # Parents are unique; a child's row stays one row, so heavy ids are looked for in the children.
    of_mothers = hot_keys(children, "MOR_ID", hot_rows, with_null=True)
    family = left_join(children, fathers, "FAR_ID", "__father", hot_rows=hot_rows, right_hot=[])
    family = left_join(family, mothers, "MOR_ID", "__mother", hot_rows=hot_rows, left_hot=of_mothers, right_hot=[])
    return family.select(*FAMILY)


def summary_before(register: DataFrame, births: DataFrame | None) -> DataFrame:
    """Children and missing parents per source, one row."""
    parts = {"bef": register} if births is None else {"bef": register, "mfr": births}
    tagged = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("source"), "FAR_ID", "MOR_ID")
        tagged = part if tagged is None else tagged.unionByName(part)
    measures = []
    for name in parts:
        here = F.col("source") == name
        measures += [
            F.count_if(here).alias(f"total_{name}_records"),
            F.count_if(here & F.col("FAR_ID").isNull()).alias(f"{name}_missing_far"),
            F.count_if(here & F.col("MOR_ID").isNull()).alias(f"{name}_missing_mor"),
        ]
    return tagged.agg(*measures)


def summary_after(combined: DataFrame) -> DataFrame:
    """Counts over the combined children, one row.

    ``records_with_family_id`` is the number older reports called
    ``records_only_in_bef``; here that name counts children of one source only.
    """
    return combined.agg(
        F.count("*").alias("total_combined_records"),
        F.count_if(F.col("FAR_ID").isNull()).alias("combined_missing_far"),
        F.count_if(F.col("MOR_ID").isNull()).alias("combined_missing_mor"),
        F.count_if(F.col("in_register") & ~F.col("in_births")).alias("records_only_in_bef"),
        F.count_if(F.col("in_births") & ~F.col("in_register")).alias("records_only_in_mfr"),
        F.count("FAMILIE_ID").alias("records_with_family_id"),
    )


def family_size(family: DataFrame, family_id: str = "family_id", child_id: str = "child_id") -> DataFrame:
    """Children per family; children without a family id form one row."""
    return family.groupBy(family_id).agg(F.count(child_id).alias("number_of_children"))


def relationships(family: DataFrame) -> DataFrame:
    return family.select(
        F.col("PNR").alias("child_id"),
        F.col("FAR_ID").alias("father_id"),
        F.col("MOR_ID").alias("mother_id"),
        F.col("FAMILIE_ID").alias("family_id"),
        F.col("FOED_DAG").alias("birth_date"),
        F.col("FAR_FDAG").alias("father_birth_date"),
        F.col("MOR_FDAG").alias("mother_birth_date"),
    )


def individuals(family: DataFrame) -> DataFrame:
    """One row per child and per known parent of each child, with the role."""
    def person(id_: str, date: str, role: str) -> Column:
        return F.struct(F.col(id_).alias("individual_id"), F.col(date).alias("birth_date"), F.lit(role).alias("role"))

    roles = F.array(
        person("PNR", "FOED_DAG", "child"), person("FAR_ID", "FAR_FDAG", "father"), person("MOR_ID", "MOR_FDAG", "mother")
    )
    rows = family.select(F.inline(roles))
    return rows.where((F.col("role") == "child") | F.col("individual_id").isNotNull())


def age_gaps(family: DataFrame) -> DataFrame:
    """Years between child and father and child and mother, one row per child."""
    return family.select(
        years_between("FOED_DAG", "FAR_FDAG").alias("father_age_diff"),
        years_between("FOED_DAG", "MOR_FDAG").alias("mother_age_diff"),
    )


def birth_dates(family: DataFrame) -> DataFrame:
    return family.select("FOED_DAG")


def births_per_year(family: DataFrame) -> DataFrame:
    return family.groupBy(F.year("FOED_DAG").alias("year")).agg(F.count("*").alias("children"))
