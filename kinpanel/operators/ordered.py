"""Previous row of the same person, also when one person holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinpanel.operators.scale import HOT_ROWS, ensure_checkpoint_dir, hot_keys

PREVIOUS = "previous"


def with_previous(
    df: DataFrame,
    person: str,
    order: list[str],
    columns: list[str],
    hot_rows: int | None = HOT_ROWS,
    within: list[str] | None = None,
) -> DataFrame:
    """Add struct ``previous`` with the values of ``columns`` in the person's preceding row.

    ``within`` names further columns that both rows must share.  Rows are ordered by ``order``, ties by the columns themselves, nulls first.
    Persons up to ``hot_rows`` rows are handled by a plain window.  The rows of
    heavier ones are sorted over the cluster by range, written to the checkpoint
    folder, and linked across range borders by one border row per range.
    Rows without a person have no preceding row.
    """
    nobody = df.where(F.col(person).isNull())
    df = df.where(F.col(person).isNotNull())
    hot = hot_keys(df, person, hot_rows)
    within = within or []
    window = Window.partitionBy(person, *within).orderBy(*order, *columns)
    lagged = F.lag(F.struct(*columns)).over(window)
    none = F.lit(None).cast(T.StructType([df.schema[c] for c in columns]))
    nobody = nobody.withColumn(PREVIOUS, none)
    if not hot:
        return df.withColumn(PREVIOUS, lagged).unionByName(nobody)
    key = T.StructType([T.StructField("__hot", df.schema[person].dataType)])
    hot_table = F.broadcast(df.sparkSession.createDataFrame([(k,) for k, _ in hot], key))
    is_hot = F.col(person).eqNullSafe(F.col("__hot"))
    rest = df.join(hot_table, is_hot, "left_anti").withColumn(PREVIOUS, lagged)
    heavy = df.join(hot_table, is_hot, "left_semi")
    ranges = 2 * -(-sum(n for _, n in hot) // hot_rows)
    return rest.unionByName(nobody).unionByName(_by_range(heavy, [person, *within], order, columns, ranges))


def _by_range(df: DataFrame, group: list[str], order: list[str], columns: list[str], ranges: int) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    # The input split is the last sort key, so equal rows can part as well.
    keys = list(dict.fromkeys([*group, *order, *columns, "__split"]))
    placed = (
        df.withColumn("__split", F.spark_partition_id())
        .repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .checkpoint()
        .withColumn("__range", F.spark_partition_id())
    )
    who = [f"__g{i}" for i in range(len(group))]

    def row(prefix: str = ""):
        return F.struct(*[F.col(prefix + c).alias(w) for c, w in zip(group, who)], *[F.col(prefix + c).alias(c) for c in columns])

    border = (
        placed.groupBy("__range")
        .agg(F.max(F.struct(*keys)).alias("__last"))
        .select(F.col("__range").alias("__at"), row("__last.").alias("__tail"))
    )
    # One row per range: the only window here without a partition key.
    border = border.select("__at", F.lag("__tail").over(Window.orderBy("__at")).alias("__before"))
    within = F.lag(row()).over(Window.partitionBy("__range").orderBy(*keys))
    linked = (
        placed.withColumn("__in", within)
        .join(F.broadcast(border), F.col("__range") == F.col("__at"))
        .withColumn("__prev", F.coalesce("__in", "__before"))
    )
    same = F.col("__prev").isNotNull()
    for c, w in zip(group, who):
        same = same & F.col(f"__prev.{w}").eqNullSafe(F.col(c))
    value = F.when(same, F.struct(*[F.col(f"__prev.{c}").alias(c) for c in columns]))
    return linked.withColumn(PREVIOUS, value).select(*df.columns, PREVIOUS)
