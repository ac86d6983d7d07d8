"""Which input files are new or changed since the last run, and the dataset catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinpanel.fixed_values import DOMAIN_DESCRIPTIONS, ZONE_DESCRIPTIONS
from kinpanel.sources.registers import with_period
from kinpanel.sources.schemas import read_each, together


def file_manifest(spark: SparkSession, register: str, path: str, fingerprint: str = "stamp") -> DataFrame:
    """One row per file: register, path, fingerprint.

    ``stamp`` is size and time of change, from the listing.  ``rows`` combines
    hashes of all rows, so large parquet files are split over tasks and rewrites
    with the same rows count as unchanged.
    """
    if fingerprint == "rows":
        df = spark.read.option("mergeSchema", True).parquet(path)
        h = F.xxhash64(*df.columns)
        marked = df.select(F.col("_metadata.file_path").alias("path"), h.alias("h"))
        # The sum tells repeated rows apart, which cancel out in the xor.
        return marked.groupBy("path").agg(
            F.concat_ws("-", F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).alias("fingerprint")
        ).select(F.lit(register).alias("register"), "path", "fingerprint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if fingerprint != "stamp":
        raise ValueError(f"unknown fingerprint {fingerprint!r}")
    mark = F.concat_ws("-", F.col("length"), F.unix_micros("modificationTime"))
    return files.select(F.lit(register).alias("register"), "path", mark.alias("fingerprint"))


def changed_files(current: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Files that are new or whose fingerprint differs."""
    if stored is None:
        return current
    return current.join(stored.select("register", "path", "fingerprint"), ["register", "path", "fingerprint"], "left_anti")


def removed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(current.select("register", "path"), ["register", "path"], "left_anti")


def missing_is_none(read):
    """What ``read()`` returns, or None where there are no files."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    return missing_is_none(lambda: spark.read.parquet(path))


def is_changed(spark: SparkSession, register: str, path: str, manifest: str, fingerprint: str = "stamp") -> bool:
    """List the register's files into a table of their own; whether one is new, changed or gone since ``mark_done``."""
    listed = f"{manifest}/listed/{register}"
    file_manifest(spark, register, path, fingerprint).write.mode("overwrite").parquet(listed)
    current, stored = spark.read.parquet(listed), read_manifest(spark, f"{manifest}/done/{register}")
    return stored is None or not (changed_files(current, stored).isEmpty() and removed_files(current, stored).isEmpty())


def mark_done(spark: SparkSession, register: str, manifest: str) -> None:
    """Remember the files listed last, and their years if they were looked at; files that arrived since count as new the next time."""
    for listed, done in (("listed", "done"), ("listed_years", "done_years")):
        found = read_manifest(spark, f"{manifest}/{listed}/{register}")
        if found is not None:
            found.write.mode("overwrite").parquet(f"{manifest}/{done}/{register}")


@dataclass(frozen=True)
class Change:
    """What has to be built again of a register: ``files`` hold all rows of ``years``; without years everything."""

    years: frozenset[int] | None = None
    files: tuple[str, ...] = ()


def _file_name(path):
    """One spelling of a file's place: listings and scans differ in slashes and in escaped characters."""
    return F.regexp_replace(F.try_url_decode(path), "^([A-Za-z0-9+.-]+):/+", "$1:/")


def file_years(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, year``: the years that each file has rows of, by a column of its own or else by its name."""
    frames = [with_period(df.withColumn("__path", F.col("_metadata.file_path"))) for df in read_each(spark, path)]
    return together([df.select(_file_name(F.col("__path")).alias("path"), F.col("year").cast("int").alias("year")) for df in frames]).distinct()


def find_change(spark: SparkSession, register: str, path: str, manifest: str, fingerprint: str = "stamp") -> Change | None:
    """What to build again since ``mark_done``, or None when no file is new, changed or gone.

    The manifest knows which years each file has rows of (``done_years``). The years of files that are new, changed or gone,
    before and now, are built again, from all files that have rows of them; only new and changed files are read to find that
    out. Everything is built again the first time, when rows without a year are touched, when a year has lost its last file, and when
    the manifest does not know a file.
    """
    if not is_changed(spark, register, path, manifest, fingerprint):
        return None
    named = lambda df: df.select(_file_name(F.col("path")).alias("path"), F.col("path").alias("place"), "fingerprint")
    current = named(spark.read.parquet(f"{manifest}/listed/{register}").select("register", "path", "fingerprint"))
    before, known = read_manifest(spark, f"{manifest}/done/{register}"), read_manifest(spark, f"{manifest}/done_years/{register}")
    listed = f"{manifest}/listed_years/{register}"
    if before is None or known is None:
        file_years(spark, path).write.mode("overwrite").parquet(listed)
        return Change()
    before = named(before)
    new = current.join(before, ["path", "fingerprint"], "left_anti")
    touched = before.join(current, ["path", "fingerprint"], "left_anti").select("path")
    places = [r["place"] for r in new.select("place").collect()]  # paths to read: no more than the register has files
    kept = known.join(new.select("path").unionByName(touched), "path", "left_anti")
    now = kept.unionByName(file_years(spark, places)) if places else kept
    now.write.mode("overwrite").parquet(listed)
    now = spark.read.parquet(listed)
    old_years = touched.join(known, "path", "left").select("year")
    new_years = now.join(new.select("path"), "path").select("year")
    years = {r["year"] for r in old_years.unionByName(new_years).distinct().collect()}
    left = {r["year"] for r in now.select("year").distinct().collect()}
    if None in years or None in left or not years <= left:
        return Change()
    wanted = now.filter(F.col("year").isin(sorted(years))).select("path").distinct()
    files = [r["place"] for r in current.join(wanted, "path").select("place").collect()]
    return Change(frozenset(years), tuple(sorted(files)))


def run_if_changed(spark: SparkSession, register: str, path: str, manifest: str, job, fingerprint: str = "stamp") -> bool:
    """Run ``job()`` when a file of the register is new, changed or gone; remember the files afterwards."""
    if not is_changed(spark, register, path, manifest, fingerprint):
        return False
    job()
    mark_done(spark, register, manifest)
    return True


def catalogue(spark: SparkSession) -> DataFrame:
    """Zones and domains of an analytical dataset with their descriptions and the time of creation."""
    rows = [("zone", k, v) for k, v in ZONE_DESCRIPTIONS.items()] + [("domain", k, v) for k, v in DOMAIN_DESCRIPTIONS.items()]
    df = spark.createDataFrame(rows, "kind string, name string, description string")
    return df.withColumn("version", F.lit("1.0")).withColumn("created_at", F.current_timestamp())


def write_catalogue(df: DataFrame, path: str) -> None:
    df.repartition(1).write.mode("overwrite").json(path)
