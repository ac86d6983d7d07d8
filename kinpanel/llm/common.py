"""Helpers shared by the operators: written intermediate tables, joins with hot keys, row identity, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of all word rules here: space and the five ASCII controls from tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: A key with more than a thousandth of all rows is joined by broadcast: there are fewer than this many of them.
HOT_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary folder only where that setting is missing (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(col).cast("binary"), F.lit(b"")))


def lookup(rows: DataFrame, table: DataFrame, key: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row per key; ``count`` says how many of the ``total`` rows have it).

    Keys with more than ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, whatever the data: that part of the
    table is broadcast and its rows are not shuffled. All other keys are small and meet by an ordinary join.
    Both inputs must be written tables (they are read twice). Null keys match nothing.
    """
    limit = max(total // HOT_KEYS, 1)
    hot = table.filter(F.col(count) > limit)
    cold = table.filter(F.col(count) <= limit)
    near = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(rest)


def word_hashes(words: list[bytes], known: dict[bytes, int], most: int = 2_000_000) -> list[int]:
    """64-bit hashes of words. ``known`` only saves time; it is emptied when it has grown large."""
    if len(known) > most:
        known.clear()
    get, of = known.get, xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = known[w] = of(w)
        out.append(h)
    return out


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join with ``table`` (one row per ``key``; ``count`` rows of ``rows`` have it) whose rows may be large.

    Nothing large is broadcast: a hot key's table row is repeated, and its rows are dealt over the repetitions by their own
    values. Only the hot keys with their number of repetitions are broadcast; there are fewer than ``HOT_KEYS``.
    """
    limit = max(total // HOT_KEYS, 1)
    ways = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = table.filter(F.col(count) > limit).select(key, ways.alias("__ways"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__slot", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__ways", F.lit(1))).cast("int"))
    copies = table.withColumn("__slot", F.explode(F.sequence(F.lit(0), ways - 1)))
    return dealt.drop("__ways").join(copies.drop(count), [key, "__slot"]).drop("__slot")
