"""Descriptive statistics as long tables: one row per group and column (or value).

Columns are unpivoted, so one pass serves all of them and every group at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.operators.columns import CATEGORICAL, NUMERIC, TEMPORAL, column_kind, columns_of_kind, require
from kinpanel.operators.quantiles import exact_quantiles, group_sizes
from kinpanel.operators.scale import attach, small

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _long(df: DataFrame, columns: list[str], by: list[str], spark_type: str) -> DataFrame:
    require(df, columns + by)
    # A grouping column may be described too, so values get names of their own.
    values = [F.col(c).cast(spark_type).alias(f"__{c}") for c in columns]
    wide = df.select(*by, *values)
    long = wide.unpivot(by, [f"__{c}" for c in columns], "column", "value")
    return long.withColumn("column", F.substr("column", F.lit(3)))


def numeric_statistics(
    df: DataFrame, columns: list[str], by: list[str] | None = None, *, quantiles: str = "auto"
) -> DataFrame:
    """count, mean, std, min, q1, median, q3, max and missing per group and column.

    ``quantiles``: ``auto`` measures the groups and then uses ``builtin`` (exact,
    one task holds a group) or ``selection`` (exact, any group size); ``approx``
    is the built-in sketch.
    """
    if quantiles not in ("auto", "builtin", "selection", "approx"):
        raise ValueError(f"unknown quantiles {quantiles!r}")
    by = by or []
    keys = [*by, "column"]
    long = _long(df, columns, by, "double")
    v = F.col("value")
    measures = [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v.isNull()).alias("missing"),
    ]
    order = [*keys, "count", "mean", "std", "min", "q1", "median", "q3", "max", "missing"]
    sizes = group_sizes(long, keys, "value") if quantiles in ("auto", "selection") else None
    if quantiles == "auto":
        quantiles = "builtin" if sizes.fit_a_task else "selection"
    if quantiles == "selection":
        quarts = exact_quantiles(long, keys, "value", QUARTILES, method="selection", sizes=sizes)
        return attach(long.groupBy(*keys).agg(*measures), quarts, keys).select(*order)
    fn = F.percentile if quantiles == "builtin" else F.percentile_approx
    measures += [fn(v, F.lit(p)).alias(name) for name, p in QUARTILES.items()]
    return long.groupBy(*keys).agg(*measures).select(*order)


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    return _long(df, columns, by, "string").groupBy(*by, "column", "value").agg(F.count("*").alias("count"))


def categorical_statistics(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count and percentage of all rows per value; null is a value of its own.

    Each row repeats the column's ``missing`` and ``total``.
    """
    by = by or []
    keys = [*by, "column"]
    counts = value_counts(df, columns, by)
    totals = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
        F.sum("count").alias("total"),
    )
    # Without groups there is one row per column listed; else the size is checked.
    totals = small(totals) if by else F.broadcast(totals)
    return attach(counts, totals, keys).select(
        *keys,
        "value",
        "count",
        (F.col("count") / F.col("total") * 100).alias("percentage"),
        "missing",
        "total",
    )


def temporal_statistics(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, min, max and missing per group and date column."""
    by = by or []
    v = F.col("value")
    return (
        _long(df, columns, by, "date")
        .groupBy(*by, "column")
        .agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v.isNull()).alias("missing"))
    )


def table_statistics(
    df: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    temporal: list[str] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Statistics of several columns in one typed long table.

    Listed columns that do not exist are left out; without lists the kinds are
    taken from the types.  ``value`` is the mean of numeric columns and the
    largest percentage of categorical ones, ``value_text`` the first date of
    temporal ones.  ``count`` is all rows for categorical columns, else non-null.
    """
    by = by or []
    free = [c for c in df.columns if c not in by]
    if numeric is None and categorical is None and temporal is None:
        numeric, categorical, temporal = ([c for c in free if column_kind(df, c) == k] for k in (NUMERIC, CATEGORICAL, TEMPORAL))
    numeric, categorical, temporal = ([c for c in (cols or []) if c in df.columns] for cols in (numeric, categorical, temporal))
    null_double = F.lit(None).cast("double")
    null_text = F.lit(None).cast("string")

    def shaped(part: DataFrame, kind: str, count: Column, value: Column, text: Column, std: Column, quarts: bool) -> DataFrame:
        extra = [F.col(c) if quarts else null_double.alias(c) for c in ("mean", "median", "q1", "q3", "min", "max")]
        return part.select(
            *by,
            "column",
            F.lit(kind).alias("stat_type"),
            count.alias("count"),
            value.alias("value"),
            text.alias("value_text"),
            std.alias("std"),
            F.col("missing"),
            *extra,
        )

    parts = []
    if numeric:
        stats = numeric_statistics(df, numeric, by)
        parts.append(shaped(stats, NUMERIC, F.col("count"), F.col("mean"), null_text, F.col("std"), True))
    if categorical:
        counts = value_counts(df, categorical, by)
        top = counts.groupBy(*by, "column").agg(
            F.sum("count").alias("total"),
            F.max("count").alias("top"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
        )
        share = F.col("top") / F.col("total") * 100
        parts.append(shaped(top, CATEGORICAL, F.col("total"), share, null_text, F.lit(0.0), False))
    if temporal:
        stats = temporal_statistics(df, temporal, by)
        first = F.col("min").cast("string")
        parts.append(shaped(stats, TEMPORAL, F.col("count"), null_double, first, F.lit(0.0), False))
    if not parts:
        raise ValueError("none of the columns asked for exists")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_statistics(df: DataFrame, columns: list[str], strata: str | None = None) -> DataFrame:
    """mean, std, median, q1, q3, n and missing per stratum; rows without a stratum are left out."""
    if strata is None:
        stats = numeric_statistics(df, columns).withColumn("stratum", F.lit("all"))
    else:
        tagged = df.where(F.col(strata).isNotNull()).withColumn("stratum", F.col(strata).cast("string"))
        stats = numeric_statistics(tagged, columns, ["stratum"])
    return stats.select(
        "column", "stratum", "mean", "std", "median", "q1", "q3", F.col("count").alias("n"), "missing"
    )


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per variable: count, null_count, mean, std, min, quartiles, max.

    Bounds of other than numeric columns are given as text.
    """
    columns = columns or df.columns
    numeric = [c for c in columns if column_kind(df, c) == NUMERIC]
    other = [c for c in columns if column_kind(df, c) != NUMERIC]
    numbers = ["mean", "std", "min", "q1", "median", "q3", "max"]
    parts = []
    if numeric:
        parts.append(
            numeric_statistics(df, numeric).select(
                F.col("column").alias("variable"),
                "count",
                F.col("missing").alias("null_count"),
                *numbers,
                F.lit(None).cast("string").alias("min_text"),
                F.lit(None).cast("string").alias("max_text"),
            )
        )
    if other:
        v = F.col("value")
        parts.append(
            _long(df, other, [], "string")
            .groupBy(F.col("column").alias("variable"))
            .agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), F.min(v).alias("min_text"), F.max(v).alias("max_text"))
            .select("variable", "count", "null_count", *[F.lit(None).cast("double").alias(n) for n in numbers], "min_text", "max_text")
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missing_table(df: DataFrame) -> DataFrame:
    """Missing values and their percentage (two decimals) per column, in one pass."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot("__n", df.columns, "column", "missing")
    share = F.when(F.col("__n") > 0, F.round(100 * F.col("missing") / F.col("__n"), 2))
    return long.select("column", "missing", share.alias("percentage"))


def non_null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "non_null")


def glance(df: DataFrame, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Missing values per column and a few sample rows."""
    return missing_table(df), df.limit(rows)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, rows, missing, distinct values (null counts as one); numeric: min, max, mean, median."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    v = F.col("value")
    texts = _long(df, df.columns, [], "string")
    if approx:
        base = texts.groupBy("column").agg(
            F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.approx_count_distinct(v).alias("__d")
        )
    else:
        # Grouping by value first spreads a long column over all tasks.
        base = (
            texts.groupBy("column", "value")
            .agg(F.count("*").alias("n"))
            .groupBy("column")
            .agg(
                F.sum("n").alias("rows"),
                F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                F.count(v).alias("__d"),
            )
        )
    base = base.select(
        "column",
        F.try_element_at(types, F.col("column")).alias("dtype"),
        "rows",
        "missing",
        (F.col("__d") + F.when(F.col("missing") > 0, 1).otherwise(0)).alias("distinct_values"),
    )
    numeric = columns_of_kind(df, NUMERIC)
    if not numeric:
        return base.select("*", *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "median")])
    stats = numeric_statistics(df, numeric, quantiles="approx" if approx else "auto")
    # One row per column on either side.
    return base.join(F.broadcast(stats.select("column", "min", "max", "mean", "median")), "column", "left")
