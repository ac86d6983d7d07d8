"""Panels kept in buckets by person, sorted: joins by person then move only the other side."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text rows a bucket of one year should hold about.
BUCKET_BYTES = 128 << 20


def _name(path: str) -> str:
    return "panel_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _description(path: str) -> str:
    return f"{path.rstrip('/')}_buckets"


def _define(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, year: str | None) -> DataFrame:
    """Tell the catalogue about the files at ``path``: columns, buckets, order, and the years there are."""
    name = _name(path)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    by = f"PARTITIONED BY ({_quoted(year)}) " if year else ""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ('partitionOverwriteMode' 'dynamic', 'compression' 'zstd') {by}"
        f"CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{path.replace(chr(39), chr(92) + chr(39))}'"
    )
    if year:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets for a table written at ``path`` before: as many as tasks after a shuffle, more where the files are large."""
    from kinpanel.sources.schemas import file_list

    size = file_list(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def write_bucketed(df: DataFrame, path: str, key: str = "PNR", buckets: int | None = None, year: str | None = "year", only_given: bool = False, observe: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Parquet in ``buckets`` by ``key``, each file sorted by it, in folders by ``year``; returns the table as ``read_bucketed`` does.

    A task writes one bucket, one file a year. ``only_given`` replaces the years that ``df`` has rows of and leaves the others;
    columns that the table has not seen are added to it. The number of buckets of a table stays as it was written first. Tables are
    compatible for joins when their numbers of buckets are equal; numbers below ``spark.sql.shuffle.partitions`` would be
    shuffled again and are refused. ``observe`` is applied to the rows as the tasks write them.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = _told(spark, path) if only_given else None
    buckets = told["buckets"] if told else buckets or least
    if buckets < least:
        raise ValueError(f"{buckets} buckets are fewer than the {least} partitions of a shuffle")
    if told:
        old = T.StructType.fromJson(told["schema"])
        new = [f for f in df.schema.fields if f.name not in old.names]
        schema = T.StructType([f for f in old.fields if f.name != year] + new + [f for f in old.fields if f.name == year])
        _define(spark, path, schema, key, buckets, year)
        same = df.select(*[(F.col(_quoted(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        observe(same.repartition(buckets, F.col(key))).write.insertInto(_name(path), overwrite=True)
    else:
        order = [c for c in df.columns if c != year] + ([year] if year else [])
        schema = df.select(*order).schema
        spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
        writer = observe(df.select(*order).repartition(buckets, F.col(key))).write.format("parquet").mode("overwrite").option("path", path).option("compression", "zstd")
        (writer.partitionBy(year) if year else writer).bucketBy(buckets, key).sortBy(key).saveAsTable(_name(path))
    about = json.dumps({"schema": json.loads(schema.json()), "key": key, "buckets": buckets, "year": year})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(_description(path))
    return read_bucketed(spark, path)


def _told(spark: SparkSession, path: str) -> dict | None:
    from kinpanel.sources.manifest import missing_is_none

    about = missing_is_none(lambda: spark.read.text(_description(path)).first())
    return None if about is None else json.loads(about["value"])


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_bucketed``, whose scans Spark knows to be in buckets; any session can open it."""
    told = _told(spark, path)
    if told is None:
        raise ValueError(f"no table in buckets at {path}")
    return _define(spark, path, T.StructType.fromJson(told["schema"]), told["key"], told["buckets"], told["year"])
