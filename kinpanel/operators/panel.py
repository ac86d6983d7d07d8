"""Person-year panels: join registers to the population, split by role, stack."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.fixed_values import LABELLED_COLUMNS, LABELS
from kinpanel.functions.labels import MAX_LITERAL_ENTRIES, label
from kinpanel.operators.columns import prefixed, unique_names
from kinpanel.operators.scale import HOT_ROWS, MAX_HOT, hot_keys, hot_keys_of, left_join, one_key, small

log = logging.getLogger(__name__)

FATHER, MOTHER = "FAR_", "MOR_"
PERSON = {"child": ("year", "PNR"), "father": ("FAR_year", "FATHER_PNR"), "mother": ("MOR_year", "MOTHER_PNR")}


Hot = list[tuple[object, int]] | None


def join_register(
    population: DataFrame, register: DataFrame, on: str | list[str] = "PNR", hot_rows: int | None = HOT_ROWS, left_hot: Hot = None, right_hot: Hot = None
) -> DataFrame:
    """Every person of the population with the person's register rows. Heavy keys that are known spare the search for them."""
    return left_join(population, register, on, hot_rows=hot_rows, left_hot=left_hot, right_hot=right_hot)


def join_parents(
    population: DataFrame, register: DataFrame, key: str = "PNR", hot_rows: int | None = HOT_ROWS, same_period: bool = False
) -> DataFrame:
    """Register rows of father and mother beside each child, prefixed ``FAR_`` and ``MOR_``.

    As the parents are joined by id alone, a child gets every combination of
    its parents' rows.  ``same_period`` keeps to combinations of one year.
    """
    father, mother = (
        prefixed(register, prefix, key).withColumnRenamed(key, f"__{prefix}key") for prefix in (FATHER, MOTHER)
    )
    of_parent = hot_keys_of(population, ["FAR_ID", "MOR_ID"], hot_rows, with_null=True)
    if not same_period:
        of_register = hot_keys(register, key, hot_rows)
        out = left_join(
            population, father, "FAR_ID", f"__{FATHER}key", hot_rows=hot_rows, left_hot=of_parent["FAR_ID"], right_hot=of_register
        )
        return left_join(
            out, mother, "MOR_ID", f"__{MOTHER}key", hot_rows=hot_rows, left_hot=of_parent["MOR_ID"], right_hot=of_register
        )
    # Years in which either parent has rows: at most one row per child and year,
    # so the heavy keys left are those of the register, by person and year.
    years = register.where(F.col("year").isNotNull()).select(F.col(key).alias("__person"), "year").distinct()
    pairs = population.select(key, "FAR_ID", "MOR_ID")
    seen = [
        left_join(pairs, years, p, "__person", hot_rows=hot_rows, left_hot=hot, right_hot=[]) for p, hot in of_parent.items()
    ]
    child_years = seen[0].unionByName(seen[1]).where(F.col("year").isNotNull()).select(F.col(key).alias("__child"), "year").distinct()
    out = left_join(population, child_years, key, "__child", hot_rows=None)
    of_register = hot_keys(register.select(one_key([key, "year"]).alias("k")), "k", hot_rows)
    for prefix, parent, side in ((FATHER, "FAR_ID", father), (MOTHER, "MOR_ID", mother)):
        side = side.withColumn("__year", F.col(f"{prefix}year"))
        out = left_join(
            out, side, [parent, "year"], [f"__{prefix}key", "__year"], hot_rows=hot_rows,
            left_hot=_by_year(of_parent[parent], years), right_hot=of_register,
        )
    return out


def join_parent(
    population: DataFrame, register: DataFrame, parent: str, key: str = "PNR", hot_rows: int | None = HOT_ROWS, left_hot: Hot = None, right_hot: Hot = None
) -> DataFrame:
    """Register rows of one parent beside each child: no product with the other parent's rows. ``parent``: father or mother."""
    prefix, own = (FATHER, "FAR_ID") if parent == "father" else (MOTHER, "MOR_ID")
    side = prefixed(register, prefix, key).withColumnRenamed(key, f"__{prefix}key")
    return left_join(population, side, own, f"__{prefix}key", hot_rows=hot_rows, left_hot=left_hot, right_hot=right_hot)


def _by_year(heavy: list[tuple[object, int]], years: DataFrame) -> list[tuple[object, int]]:
    """Heavy parents by parent and year; a parent has a row per child and year at most."""
    count = {k: n for k, n in heavy if k is not None}
    found = [(None, n) for k, n in heavy if k is None]
    if count:
        parents = years.sparkSession.createDataFrame([(k,) for k in count], years.select("__person").schema)
        rows = years.join(F.broadcast(parents), "__person").select("__person", one_key(["__person", "year"]).alias("k"))
        # Only steers the spreading of rows; a list cut here leaves some keys in one task. The parents with most children come first.
        most = F.broadcast(years.sparkSession.createDataFrame(list(count.items()), f"__person {years.schema['__person'].dataType.simpleString()}, n long"))
        rows = rows.join(most, "__person").orderBy(F.desc("n"), "k").limit(MAX_HOT)
        found += [(r["k"], r["n"]) for r in rows.collect()]
    return found


def label_codes(df: DataFrame, register: str, dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Labels for the register's coded columns.

    Short dictionaries are part of the package; longer ones (citizenship) are
    given as tables with ``code`` and ``label``.  A column without a dictionary
    keeps its codes.
    """
    out = df
    for column in LABELLED_COLUMNS.get(register, []):
        name = column.lower()
        if column not in out.columns:
            continue
        if dictionaries and name in dictionaries:
            out = apply_dictionary(out, column, dictionaries[name])
        elif name in LABELS:
            out = with_label(out, column, LABELS[name])
        else:
            log.warning("no dictionary for %s: its codes stay", column)
    return out


def with_label(df: DataFrame, column: str, entries: dict[str, str]) -> DataFrame:
    """Labels from a dictionary: as a map in the plan when short, else by a join."""
    if len(entries) <= MAX_LITERAL_ENTRIES:
        return df.withColumn(column, label(column, entries))
    return apply_dictionary(df, column, df.sparkSession.createDataFrame(list(entries.items()), "code string, label string"))


def apply_dictionary(df: DataFrame, column: str, dictionary: DataFrame, into: str | None = None) -> DataFrame:
    """Label from a ``code``/``label`` table; unmapped codes pass through, null stays null."""
    target = into or column
    side = small(dictionary.select(F.col("code").alias("__code"), F.col("label").alias("__label")))
    code = F.col(column).cast("string")
    joined = df.join(side, code == F.col("__code"), "left")
    return joined.withColumn(target, F.coalesce("__label", code)).drop("__code", "__label")


def add_education_level(df: DataFrame, levels: DataFrame, column: str = "HFAUDD") -> DataFrame:
    """``EDU_LVL`` from a table of education codes; null where the code is unknown."""
    side = small(levels.select(F.col("HFAUDD").alias("__hfaudd"), "EDU_LVL"))
    return df.join(side, F.col(column) == F.col("__hfaudd"), "left").drop("__hfaudd")


def stack_registers(registers: list[DataFrame] | dict[str, DataFrame]) -> DataFrame:
    """Rows of several registers under the union of their columns; a dict adds their names as ``register``."""
    if not registers:
        raise ValueError("no registers to stack")
    if isinstance(registers, dict):
        registers = [df.withColumn("register", F.lit(name)) for name, df in registers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), registers)


def split_roles(panel: DataFrame) -> dict[str, DataFrame]:
    """Panels of child, mother and father, with the person keys renamed.

    A parent's panel is given when the table has columns with its prefix.
    """
    shared = [c for c in ("PNR", "year", "month", "register") if c in panel.columns]
    own = [c for c in panel.columns if not c.startswith((FATHER, MOTHER))]
    roles = {"child": unique_names(panel.select(*own))}
    for role, prefix, key in (("mother", MOTHER, "MOR_ID"), ("father", FATHER, "FAR_ID")):
        columns = [c for c in panel.columns if c.startswith(prefix)]
        if columns:
            names = {"PNR": "CHILD_PNR", key: f"{role.upper()}_PNR"}
            roles[role] = panel.select(*shared, *columns).withColumnsRenamed(names)
    return roles


def year_gaps(df: DataFrame, year: str = "year") -> DataFrame:
    """Years without rows between the first and the last year."""
    years = df.where(F.col(year).isNotNull()).select(F.col(year).cast("int").alias("year")).distinct()
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).where(F.col("a").isNotNull())
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(years, "year", "left_anti")

