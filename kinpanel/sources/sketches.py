"""Sketches of a written panel, kept beside it in a folder a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinpanel.operators.scale import HOT_ROWS, hot_of_sketches, key_sketches
from kinpanel.operators.sketches import profile_of_sketches, sketch_columns
from kinpanel.sources.tables import exists, of_years, read_panel, write_table


def sketch_path(panel: str) -> str:
    return f"{panel.rstrip('/')}_sketches"


def write_sketches(spark: SparkSession, panel: str, years: frozenset[int] | None = None, year: str = "year") -> None:
    """Sketches of a written panel beside it, in a folder a year; with ``years`` only those folders are read and replaced."""
    df = read_panel(spark, panel)
    df = df if years is None else of_years(df, years, year)
    write_table(sketch_columns(df, year), sketch_path(panel), partition_by=year, only_given=years is not None)


def profile_panel(spark: SparkSession, panel: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Profile of a panel, or of some of its years, from the sketches kept beside it. The panel itself is not read."""
    return profile_of_sketches(read_panel(spark, sketch_path(panel), first_year, last_year))


def key_path(table: str) -> str:
    return f"{table.rstrip('/')}_keys"


def write_key_sketches(spark: SparkSession, table: str, keys: list[str], years: frozenset[int] | None = None, year: str | None = "year") -> None:
    """Sketches of a written table's frequent keys beside it, by year if it has years; only those of ``years`` are made again."""
    df = read_panel(spark, table)
    df = df if years is None else of_years(df, years, year)
    write_table(key_sketches(df, keys, year), key_path(table), partition_by=year, only_given=years is not None)


def stored_hot_keys(spark: SparkSession, table: str, key: str, hot_rows: int | None = HOT_ROWS, with_null: bool = False) -> list[tuple[object, int]] | None:
    """Heavy keys of a written table from the sketches beside it, or None where there are none: joins then look for them themselves."""
    if not exists(spark, key_path(table)):
        return None
    return hot_of_sketches(read_panel(spark, key_path(table)), key, hot_rows, with_null)
