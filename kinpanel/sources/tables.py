"""Writing and reading panels, datasets and report files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinpanel.sources.schemas import read_reconciled

# About 1 GiB of a narrow panel; writers start a new file beyond it.
ROWS_PER_FILE = 20_000_000


def write_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None, mode: str = "overwrite", only_given: bool = False) -> None:
    """Parquet, snappy; the rows of a large partition value are split over several files. ``only_given`` leaves other partitions as they are."""
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    out = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic" if only_given else "static").option("compression", "snappy").option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_observed(df: DataFrame, path: str, measures: dict[str, Column], write=write_table) -> dict[str, object]:
    """Write a table and return ``measures`` of all its rows, taken by the tasks that write them: no job of their own.

    ``write(df, path)`` must write the rows as they come; after a shuffle, rows of a task that is run again would count twice.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), path)
    return seen.get


def row_marks(*columns: str) -> dict[str, Column]:
    """Measures that tell whether two tables have the same rows of these columns, in whatever order: number, xor and sum of hashes."""
    h = F.xxhash64(*columns)
    return {"n": F.count(F.lit(1)), "x": F.coalesce(F.bit_xor(h), F.lit(0)), "s": F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))}


def write_panel(
    df: DataFrame, path: str, partition_by: str = "year", sort_by: list[str] | None = None, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite", only_given: bool = False
) -> None:
    """Panel partitioned by year, zstd, rows of a file ordered by person. ``only_given`` leaves years that ``df`` has no rows of as they are.

    The rebalance hint moves each year together but lets the runtime split a
    year that is too large for one task.
    """
    order = [c for c in (sort_by or ["PNR"]) if c in df.columns]
    placed = df.hint("rebalance", F.col(partition_by)).sortWithinPartitions(partition_by, *order)
    (
        placed.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if only_given else "static")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 3)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(partition_by)
        .parquet(path)
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        return not files.select("path").isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_panel(spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Panel, optionally for a range of years; other years' folders are not read. Years may differ in columns and types."""
    df = read_reconciled(spark, path, base=path)
    if first_year is not None:
        df = df.where(F.col("year") >= first_year)
    if last_year is not None:
        df = df.where(F.col("year") <= last_year)
    return df


def of_years(df: DataFrame, years: frozenset[int] | set[int], year: str = "year") -> DataFrame:
    """Rows of some years; other years' folders are not read."""
    return df.where(F.col(year).isin(sorted(years)))


def partition_rows(spark: SparkSession, path: str, key: str = "year") -> DataFrame:
    """Files and bytes per partition folder of a dataset, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    value = F.nullif(F.regexp_extract("path", f"/{key}=([^/]*)/", 1), F.lit(""))
    return files.select(value.alias(key), "length").where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def check_partitions(spark: SparkSession, path: str, key: str = "year") -> DataFrame:
    """Years between the first and the last partition that have no file, one row each.

    Raises when the dataset has no partition at all.
    """
    found = partition_rows(spark, path, key).select(F.col(key).try_cast("int").alias(key))
    span = found.agg(F.min(key).alias("a"), F.max(key).alias("b"))
    if span.first()["a"] is None:
        raise ValueError(f"no {key} partitions in {path}")
    return span.select(F.explode(F.sequence("a", "b")).alias(key)).join(found, key, "left_anti")


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report table as CSV with a header.

    Reports are aggregates of few rows and go to one file; row-level listings
    should be written by ``write_listing``.
    """
    # A shuffle to one task keeps the work before it parallel.
    df.repartition(1).write.mode(mode).option("header", True).csv(path)


def write_listing(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Row-level CSV output, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)
