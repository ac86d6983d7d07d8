"""Register files: one parquet file (or folder) per year or month, named after its period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinpanel.fixed_values import BEF_FAMILY, MFR, PANEL_DROPS, REGISTERS
from kinpanel.functions.dates import file_month, file_year, parse_date
from kinpanel.operators.columns import apply_layout, in_order_of, keep_existing, keep_or_drop
from kinpanel.sources.schemas import read_each, read_reconciled, together


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file, folder or glob; files may lack columns that others have, and have columns of other types (see ``read_reconciled``)."""
    return read_reconciled(spark, path)


def with_period(df: DataFrame) -> DataFrame:
    """``year`` and ``month`` from the name of the file a row was read from; null when the name has none.

    The table must come straight from a read.  Columns that exist are kept.
    A file may be a folder written by Spark: its part files carry random digits,
    so the folder's name counts.
    """
    path = F.split("_metadata.file_path", "/")
    file, parent = F.element_at(path, -1), F.element_at(path, -2)
    name = F.when(file.rlike(r"^part-\d{5}-"), parent).otherwise(file)
    found = {"year": file_year(name), "month": file_month(name)}
    return df.select("*", *[c.alias(n) for n, c in found.items() if n not in df.columns])


def read_register(
    spark: SparkSession,
    name: str,
    path: str | list[str],
    *,
    keep: list[str] | None = None,
    drop: list[str] | None = None,
    layout: dict[str, str] | None = None,
    cast: str = "strict",
    ordered: bool = False,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Yearly panel of a register: all files in one scan, period columns, types, columns kept or dropped.

    Without lists the register's usual columns are dropped.  ``ordered`` sorts
    the whole table by year and person.  ``prepare`` is applied first, to rows with all
    columns of their files and the period.
    """
    if keep and drop:
        raise ValueError("give columns to keep or columns to drop, not both")
    wanted = layout if layout is not None else REGISTERS.get(name, {})

    def shaped(df: DataFrame) -> DataFrame:
        df = with_period(df)
        if prepare:
            df = prepare(df)
        if keep:
            df = keep_existing(df, keep)
        else:
            df = keep_or_drop(df, drop=drop if drop is not None else PANEL_DROPS.get(name, []))
        return apply_layout(df, {c: t for c, t in wanted.items() if c in df.columns}, cast)

    df = read_reconciled(spark, path, shaped)
    return in_order_of(df, ["year", "PNR"]) if ordered else df


def _require_any(frames: list[DataFrame], names: list[str]) -> None:
    """Every column must be in some file; the others have nulls there."""
    missing = [c for c in names if not any(c in df.columns for df in frames)]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))


def _people(df: DataFrame, columns: dict[str, str], born: str) -> DataFrame:
    """Person columns as text under common names, the birth date parsed, the file's period."""
    text = [(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(n) for c, n in columns.items() if c != born]
    date = parse_date(born, df.schema[born].dataType) if born in df.columns else F.lit(None).cast("date")
    return with_period(df).select(*text, date.alias("FOED_DAG"), "year", "month")


def read_population(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Family columns of the population register as text, birth dates parsed, with the file's period."""
    frames = read_each(spark, path)
    _require_any(frames, BEF_FAMILY)
    return together([_people(df, {c: c for c in BEF_FAMILY}, "FOED_DAG") for df in frames])


def read_births(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """Birth register under the population register's names, or None where there are no files.

    A needed column that no file has is an error.
    """
    try:
        frames = read_each(spark, path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    _require_any(frames, list(MFR))
    names = {"CPR_BARN": "PNR", "CPR_FADER": "FAR_ID", "CPR_MODER": "MOR_ID"}
    rows = together([_people(df, names | {"FOEDSELSDATO": "FOED_DAG"}, "FOEDSELSDATO") for df in frames])
    return rows.withColumn("FAMILIE_ID", F.lit(None).cast("string")).select("PNR", "FAR_ID", "MOR_ID", "FOED_DAG", "FAMILIE_ID", "year", "month")
