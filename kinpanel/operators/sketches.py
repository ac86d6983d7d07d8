"""Mergeable sketches of a panel's columns, kept by year: profiles read them in place of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.operators.columns import NUMERIC, columns_of_kind

#: Bits of a distinct-count sketch: the estimate's relative standard error is 1.04 / sqrt(2 ** bits).
BITS = 14
ERROR = 1.04 / 2 ** (BITS / 2)


def sketch_columns(df: DataFrame, by: str = "year") -> DataFrame:
    """One row per ``by`` and column, from one pass: ``column, dtype, rows, missing``, ``distinct`` (a HyperLogLog sketch of the values
    as text) and, of numeric columns, ``min, max, sum`` and ``quantiles`` (a KLL sketch).

    A row holds about 16 KB of sketch however many rows it stands for, and rows of the same column merge.
    """
    columns = [c for c in df.columns if c != by]
    numeric = set(columns_of_kind(df, NUMERIC))
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("binary")

    def measures(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        v = c.cast("double") if name in numeric else none
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(dtype).alias("dtype"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(c.isNull()).alias("missing"),
            F.hll_sketch_agg(c.cast("string"), F.lit(BITS)).alias("distinct"),
            (F.min(v) if name in numeric else none).alias("min"),
            (F.max(v) if name in numeric else none).alias("max"),
            (F.sum(v) if name in numeric else none).alias("sum"),
            (F.kll_sketch_agg_double(v) if name in numeric else empty).alias("quantiles"),
        )

    dtypes = dict(df.dtypes)
    wide = df.groupBy(by).agg(*[measures(c, dtypes[c]).alias(f"__{i}") for i, c in enumerate(columns)])
    return wide.select(by, F.explode(F.array(*[F.col(f"__{i}") for i in range(len(columns))])).alias("s")).select(by, "s.*")


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """``statistics.profile`` from sketches of any years: rows, missing, min and max are exact; mean is the sum's; distinct values
    (null counts as one) and the median are estimates. Columns whose type differs between years show the types."""
    merged = sketches.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_set("dtype")), ", ").alias("dtype"),
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("__d"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("__s"),
        F.kll_merge_agg_double("quantiles").alias("__q"),
    )
    filled = F.col("rows") > F.col("missing")
    return merged.select(
        "column",
        "dtype",
        "rows",
        "missing",
        (F.col("__d") + F.when(F.col("missing") > 0, 1).otherwise(0)).alias("distinct_values"),
        "min",
        "max",
        F.try_divide("__s", F.col("rows") - F.col("missing")).alias("mean"),
        F.when(filled & F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("__q", F.lit(0.5))).alias("median"),
    )
