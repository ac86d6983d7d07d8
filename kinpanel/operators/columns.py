"""Schema-level operators: choose, cast, check, rename. None of them starts a job."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinpanel.fixed_values import TYPE_NAMES

log = logging.getLogger(__name__)

PERIOD = ("year", "month")
NUMERIC, TEMPORAL, CATEGORICAL = "numeric", "temporal", "categorical"


def existing(df: DataFrame, wanted: list[str], always: tuple[str, ...] = PERIOD) -> list[str]:
    """The wanted columns that exist, then the ``always`` columns that exist."""
    present = set(df.columns)
    missing = [c for c in wanted if c not in present]
    if missing:
        log.warning("columns not found: %s", ", ".join(missing))
    kept = [c for c in wanted if c in present]
    return kept + [c for c in always if c in present and c not in kept]


def keep_existing(df: DataFrame, wanted: list[str], always: tuple[str, ...] = PERIOD) -> DataFrame:
    """Select the wanted columns that exist; if there are none, leave the table as it is."""
    kept = existing(df, wanted, always)
    return df.select(*kept) if kept else df


def keep_or_drop(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    if keep and drop:
        raise ValueError("give columns to keep or columns to drop, not both")
    if keep:
        require(df, keep)
        return df.select(*keep)
    return df.drop(*drop) if drop else df


def apply_layout(df: DataFrame, layout: dict[str, str], mode: str = "strict") -> DataFrame:
    """Cast the columns that the layout names and the table has.

    ``strict`` fails on a value that does not fit, ``try`` makes it null.
    Columns outside the layout pass through.
    """
    casts = {}
    for name, type_name in layout.items():
        if name not in df.columns:
            log.warning("column %s of the layout is not in the data", name)
            continue
        spark_type = TYPE_NAMES.get(type_name.lower(), type_name)
        c = F.col(name)
        casts[name] = c.try_cast(spark_type) if mode == "try" else c.cast(spark_type)
    return df.withColumns(casts) if casts else df


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required: list[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))


def column_kind(df: DataFrame, name: str) -> str:
    """Numeric, temporal or categorical, by type."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return CATEGORICAL


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [c for c in df.columns if column_kind(df, c) == kind]


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """Prefix every column but the key."""
    return df.select(*[F.col(c).alias(c if c == key else prefix + c) for c in df.columns])


def unique_names(df: DataFrame) -> DataFrame:
    """Give repeated column names the suffixes ``_1``, ``_2``, ..."""
    names: list[str] = []
    for c in df.columns:
        name, i = c, 1
        while name in names:
            name, i = f"{c}_{i}", i + 1
        names.append(name)
    return df.toDF(*names)


def in_order_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The whole table ordered by ``keys``; unchanged (with a warning) when one is absent."""
    absent = missing_columns(df, keys)
    if absent:
        log.warning("not ordered, missing columns: %s", ", ".join(absent))
        return df
    return df.orderBy(*keys)
