"""Line deduplication by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import lookup, stored

#: A line is boilerplate of a host when more than this share of the host's pages has it ...
MAX_RATIO = 0.1
#: ... and at least so many pages do.
MIN_PAGES = 5


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host_key``, ``pages`` of the host and ``lines``, the 64-bit hashes of its boilerplate lines.

    A host has fewer than (mean lines of a page / ``max_ratio``) such lines, so the list is short whatever the host's size.
    Lines are counted once a page; the counts are combined before the shuffle, so a common line or host costs no more.
    """
    texts = pages.filter(F.col(text_col).isNotNull()).select(_key(host_col), F.split(text_col, "\n").alias("__lines"))
    totals = texts.groupBy("host_key").agg(F.count("*").alias("pages"))
    counted = (
        texts.select("host_key", F.explode(F.array_distinct("__lines")).alias("__line"))
        .filter(F.trim("__line") != "")
        .groupBy("host_key", F.xxhash64("__line").alias("__hash"))
        .agg(F.count("*").alias("__n"))
        .filter(F.col("__n") >= min_pages)
    )
    frequent = (
        counted.join(totals, "host_key")
        .filter(F.col("__n") > F.lit(float(max_ratio)) * F.col("pages"))
        .groupBy("host_key")
        .agg(F.sort_array(F.collect_list("__hash")).alias("lines"))
    )
    empty = F.array().cast("array<bigint>")
    return totals.join(frequent, "host_key", "left").withColumn("lines", F.coalesce("lines", empty))


def _key(host_col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host_key")


def dedup_lines(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines of their host taken out of ``text_col``, and ``n_lines`` and ``n_dropped``.

    No row is dropped: a page of boilerplate only keeps an empty text. Blank lines always stay. Rows without a host form
    one host of their own. A null text stays null with 0 lines and is no page of its host; an empty text is a page with
    one blank line. Repeated rows count as pages of their own: when copies of one text are more than ``max_ratio`` of a host's
    pages (and at least ``min_pages``), all its lines are boilerplate and every copy keeps an empty text. Other columns are kept as they are; the columns
    ``n_lines`` and ``n_dropped`` of the input, if any, are replaced. An empty table gives an empty table.
    Hosts are looked up without moving the texts of large hosts (see ``lookup``).
    """
    table = stored(boilerplate(pages, host_col, text_col, max_ratio, min_pages))
    total = table.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    keep = [c for c in pages.columns if c not in ("n_lines", "n_dropped", "host_key", "pages", "lines", "__all", "__kept")]
    renamed = {c: f"__in_{c}" for c in ("host_key", "pages", "lines") if c in pages.columns}
    rows = pages.select(*keep, *[F.col(a).alias(b) for a, b in renamed.items()]).withColumn("host_key", _key(host_col if host_col not in renamed else renamed[host_col]))
    out = lookup(rows, table, ["host_key"], "pages", total, how="left")
    out = out.withColumn("__all", F.split(text_col, "\n")).withColumn(
        "__kept", F.filter("__all", lambda x: ~F.coalesce(F.array_contains(F.col("lines"), F.xxhash64(x)) & (F.trim(x) != ""), F.lit(False)))
    )
    out = out.withColumn("n_lines", F.greatest(F.size("__all"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.greatest(F.size("__kept"), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.array_join("__kept", "\n"))
    plain = [F.col(text_col) if c == text_col else F.col(renamed.get(c, c)).alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped", "__all", "__kept")]
    return out.select(*plain, "n_lines", "n_dropped")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(documents, "source", "text").select("doc_id", "n_lines", "n_dropped", "text")


LINE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS h, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT h, count(*) AS n FROM d WHERE text IS NOT NULL GROUP BY h),
lines AS (SELECT h, unnest(list_distinct(ls)) AS line FROM d WHERE text IS NOT NULL),
counted AS (SELECT h, line, count(*) AS k FROM lines WHERE trim(line, ' ') <> '' GROUP BY h, line),
bad AS (SELECT h, list(line) AS b FROM counted JOIN totals USING (h) WHERE k >= {MIN_PAGES} AND k > {MAX_RATIO}::DOUBLE * n GROUP BY h),
j AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(b, []), x)) AS kept FROM d LEFT JOIN bad USING (h))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text
FROM j
"""
