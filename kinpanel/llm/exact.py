"""Exact deduplication: an extendible-hash index in shared files, built by tasks that each own ranges of keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import BLANKS, lookup, partitions, stored

#: Keys a bucket may hold before it is split, and the most buckets (bits) of the directory.
CAPACITY = 4096
BITS = 16


def normalized(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, " ")


def directory(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Buckets (first cell, depth) in key order. ``counts``: keys by the first ``BITS`` bits of the hash. One bucket at first;
    while one holds more than ``capacity`` keys, it is split by its next bit, which doubles the directory when the
    bucket is as deep as that. At ``BITS`` bits a bucket stays as it is: its keys are chained."""
    sums = np.zeros(1 << BITS, np.int64)
    for cell, n in counts.items():
        sums[cell] = n
    upto = np.concatenate([[0], np.cumsum(sums)])
    todo, done = [(0, 0)], []
    while todo:
        first, depth = todo.pop()
        width = 1 << (BITS - depth)
        if depth < BITS and upto[first + width] - upto[first] > capacity:
            todo += [(first + width // 2, depth + 1), (first, depth + 1)]
        else:
            done.append((first, depth))
    return sorted(done)


def _combined(batches: Iterator[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch become one row with their smallest id and number: no text is common after this."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        found: dict[bytes, list] = {}
        for i, (doc, key, text) in enumerate(zip(ids, batch.column(1).to_pylist(), texts, strict=True)):
            row = found.setdefault(text, [doc, key, i, 0])
            row[3] += 1
            if doc is not None and (row[0] is None or doc < row[0]):
                row[0] = doc
        rows = list(found.values())
        keys = np.array([r[1] for r in rows], np.int64)
        buckets = np.searchsorted(starts, (keys.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64), "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array(keys), pa.array(buckets.astype(np.int32)), pa.array([r[3] for r in rows], pa.int64()), batch.column(2).take(pa.array([r[2] for r in rows], pa.int64()))],
            names=["keep_id", "key", "bucket", "group_size", "body"],
        )


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets in key order -> index entries. Texts under one key are chained and told apart by their bytes."""

    def entries(bucket, key, chain):
        return [(bucket, key, place, hashlib.sha256(text).hexdigest(), keep, size) for place, (text, keep, size) in enumerate(chain)]

    at, chain, out, kind = None, [], [], None
    names = ["bucket", "key", "place", "text_sha256", "keep_id", "group_size"]

    def table(rows):
        cols = list(zip(*rows, strict=True))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), kind, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for keep, key, bucket, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (bucket, key):
                if at:
                    out += entries(*at, chain)
                at, chain = (bucket, key), []
            for link in chain:
                if link[0] == text:
                    link[2] += size
                    if keep is not None and (link[1] is None or keep < link[1]):
                        link[1] = keep
                    break
            else:
                chain.append([text, keep, size])
        if out:
            yield table(out)
            out = []
    if at:
        yield table(out + entries(*at, chain))


def build_index(documents: DataFrame, keys: DataFrame, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    """The written index: ``bucket, key, place`` in the key's chain, ``text_sha256, keep_id, group_size`` of each distinct text.

    ``keys`` has the column ``key`` of all documents; only its counts by the first bits of the hash reach the driver
    (65,536 numbers at most). Texts are shuffled once, after equal texts of a batch have become one row, to the owner of
    their bucket. An owner reads its rows in key order and holds one chain at a time.
    """
    spark = documents.sparkSession
    cell = F.shiftrightunsigned("key", 64 - BITS).alias("cell")
    counts = dict(keys.groupBy("key").agg(F.count("*")).groupBy(cell).count().collect())
    total, parts = sum(counts.values()), partitions(spark)
    capacity = max(total >> (BITS - 2), min(CAPACITY, total // (16 * parts)), 1)
    starts = np.array([first for first, _ in directory(counts, capacity)], np.int64)
    kind = documents.schema[id_col].dataType.simpleString()
    body = normalized(text_col)
    rows = documents.select(F.col(id_col).alias("keep_id"), (F.xxhash64(body) if key is None else key).alias("key"), body.cast("binary").alias("body"))
    combined = rows.mapInArrow(lambda batches: _combined(batches, starts), f"keep_id {kind}, key long, bucket int, group_size long, body binary")
    owned = combined.repartition(parts, "bucket").sortWithinPartitions("bucket", "key")
    return stored(owned.mapInArrow(_owned, f"bucket int, key long, place int, text_sha256 string, keep_id {kind}, group_size long"))


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=F.xxhash64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, after each run of ASCII white space has become one space; null counts as
    empty. The row with the smallest id stays; where rows repeat that id, one of them. Null ids come last: they stay only
    in groups without any id, where one row stays and ``keep_id`` is null. Other columns are not read.
    An empty table gives an empty table. Texts cross the network once; ids and digests twice.
    """
    body = normalized(text_col)
    prints = stored(
        documents.select(F.col(id_col).alias("doc_id"), body.alias("body")).select(
            "doc_id", key("body").alias("key"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
        )
    )
    index = build_index(documents, prints, id_col, text_col, key(body))
    if index.groupBy("key", "text_sha256").count().filter("count > 1").limit(1).count():
        raise ValueError("different texts with one SHA-256")
    # Rows that repeat an id with its text: the first written one counts. Usually there are none.
    id_key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    again = stored(prints.groupBy(id_key.alias("id_key"), "text_sha256").agg(F.min("row").alias("first_row"), F.count("*").alias("n")).filter("n > 1"))
    total = prints.count()
    found = lookup(prints, index, ["key", "text_sha256"], "group_size", total)
    found = found.withColumn("id_key", id_key)
    if again.limit(1).count():
        found = lookup(stored(found), again, ["id_key", "text_sha256"], "n", total, how="left")
    else:
        found = found.withColumn("first_row", F.lit(None).cast("long"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("first_row") == F.col("row"), F.lit(True))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
