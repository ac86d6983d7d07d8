"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.llm.common import lookup, partitions, stored

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a document may be taken.
SHARE, CAP = 1.5, 2
#: A source is balanced when its expected words differ from the target by this part at most.
CLOSE, STEPS = 1e-7, 80
#: Rates are summed as whole multiples of 2^-20, so that sums do not depend on their order.
_UNIT = 1 << 20
#: Places in the order of drawing are numbers of 40 bits, found ten bits at a time.
_BITS, _STEP = 40, 10


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 by code point, the null source last: ranges over the cluster, then one offset per range."""
    order = [F.col("skey") == "", F.col("skey")]
    ranged = stored(sources.repartitionByRange(partitions(sources.sparkSession), *order).withColumn("range", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("range").count().collect())  # one number a partition
    offsets, upto = [], 0
    for r in sizes:
        offsets.append((r[0], upto))
        upto += r[1]
    if not offsets:
        return ranged.drop("range").withColumn("rank", F.lit(0).cast("long"))
    at = ranged.sparkSession.createDataFrame(offsets, "range int, offset long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(at), "range").withColumn("rank", F.col("offset") + inside - 1).drop("range", "offset")


def _targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target``: shares by weight, none above ``cap`` times its source; what is cut off is shared again by weight.
    All uncapped sources then have one ratio of target to weight; it is found from sums over the sources alone."""
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * F.lit(float(cap))
    level, before = 0.0, -1.0
    while level != before:
        before = level
        full = most < F.lit(level) * F.col("weight")
        cut, weight = sources.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        level = (total - cut) / weight if weight else before
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), most))


def _rate(cap: float) -> Column:
    """The tilted rate: exp(tilt * size / mean), stopped at ``cap``; ``full`` sources take every document ``cap`` times."""
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(cap))))


def _balanced(hist: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Adds ``tilt``, the minimiser of the convex dual of: least relative entropy of document rates to 1, given that a
    source's expected words are its target and no rate is above ``cap``. The dual parts by source; its slope is
    expected words minus target. Newton steps for all sources at once, each step one aggregate over the counts by
    (source, size); a step that leaves the bracket known so far is replaced by halving or doubling."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    state = stored(
        sources.withColumn("full", F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-9)))
        .withColumns({"tilt": F.lit(0.0), "low": low, "high": high, "mean": F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))})
        .withColumn("open", ~F.col("full"))
    )
    for _ in range(STEPS):
        if not state.filter("open").limit(1).count():
            break
        rate = F.round(_rate(cap) * _UNIT).cast("long")
        words = (F.col("size") * F.col("n")).cast("decimal(38,0)")
        sums = (
            hist.filter("size > 0")
            .join(state.filter("open").select("skey", "full", "tilt", "mean"), "skey")
            .groupBy("skey")
            .agg(
                (F.sum(words * rate) / _UNIT).cast("double").alias("got"),
                F.sum(F.when(rate < int(cap * _UNIT), words * rate * F.col("size"))).cast("double").alias("bend"),
            )
        )
        joined = state.join(sums, "skey", "left")
        off = F.col("got") - F.col("target")
        low_ = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high_ = F.when(off < 0, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") - off / (F.col("bend") / _UNIT / F.col("mean"))
        stepped = (
            F.when((newton > low_) & (newton < high_), newton)
            .when(high_ == float("inf"), 2 * F.abs(F.col("tilt")) + 1)
            .when(low_ == float("-inf"), -2 * F.abs(F.col("tilt")) - 1)
            .otherwise((low_ + high_) / 2)
        )
        still = F.col("open") & (F.abs(off) > F.lit(CLOSE) * F.col("target") + 0.5)
        # A bracket that no number lies in ends the search too.
        still = still & ((high_ - low_ > 1e-13) | F.isnull(high_ - low_))
        changed = joined.withColumns({"__s": still, "__l": low_, "__h": high_, "__t": stepped})
        state = stored(
            changed.select(
                *[c for c in sources.columns],
                "full",
                "mean",
                F.when(F.col("__s"), F.col("__t")).otherwise(F.col("tilt")).alias("tilt"),
                F.when(F.col("open"), F.col("__l")).otherwise(F.col("low")).alias("low"),
                F.when(F.col("open"), F.col("__h")).otherwise(F.col("high")).alias("high"),
                F.coalesce(F.col("__s"), F.lit(False)).alias("open"),
            )
        )
    return state.drop("low", "high", "open")


def _drawn(cap: float, id_col: str) -> dict[str, Column]:
    """``rate``, whole copies, and the ``place`` in the order of drawing for the broken part: hash over that part, as sequential
    Poisson sampling has it. Documents with a small place are drawn first; null where there is nothing to draw."""
    rate = _rate(cap)
    part = rate - F.floor(rate)
    chance = (F.pmod(F.xxhash64(F.lit(41), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    ratio = chance / part
    place = F.floor(ratio / (1 + ratio) * float(1 << _BITS)).cast("long")
    return {"rate": rate, "whole": F.floor(rate).cast("long"), "place": F.when((part > 0) & (F.col("size") > 0), place)}


def _cut(base: DataFrame, sources: DataFrame, total: int, cap: float) -> DataFrame:
    """Adds ``cut``: documents with places below it are drawn. The words drawn come as near to what whole copies leave
    open as one document allows. Found by radix selection: sums of words by source and the next ten bits."""
    rows = stored(lookup(base, sources, ["skey"], "docs", total).withColumns(_drawn(cap, "doc_id")).select("skey", "docs", "size", "whole", "place"))
    taken = rows.groupBy("skey").agg(F.sum(F.col("whole") * F.col("size")).alias("whole_words"))
    state = stored(
        sources.join(taken, "skey", "left").select("skey", "docs", (F.col("target") - F.coalesce("whole_words", F.lit(0))).alias("open_words"), F.lit(0).cast("long").alias("prefix"))
    )
    for shift in range(_BITS - _STEP, -1, -_STEP):
        cells = (
            lookup(rows.filter("place is not null").drop("docs"), state, ["skey"], "docs", total)
            .filter(F.shiftright("place", shift + _STEP) == F.col("prefix"))
            .groupBy("skey", F.shiftright("place", shift).alias("cell"))
            .agg(F.sum("size").alias("words"))
        )
        upto = Window.partitionBy("skey").orderBy("cell")  # at most 2^10 cells a source
        run = cells.join(state.select("skey", "open_words"), "skey").withColumn("upto", F.sum("words").over(upto))
        # The first cell that reaches the open words; all before it are drawn.
        hit = run.filter(F.col("upto") >= F.col("open_words")).groupBy("skey").agg(F.min(F.struct("cell", "words", "upto")).alias("hit"))
        last = run.groupBy("skey").agg(F.max("cell").alias("last"), F.sum("words").alias("all_words"))
        joined = state.join(hit, "skey", "left").join(last, "skey", "left")
        prefix = F.coalesce(F.col("hit.cell"), F.col("last") + 1, F.shiftleft(F.col("prefix"), _STEP))
        left = F.when(F.col("hit").isNotNull(), F.col("open_words") - (F.col("hit.upto") - F.col("hit.words"))).otherwise(F.col("open_words") - F.coalesce("all_words", F.lit(0)))
        # The last cell is one place: taken when that is nearer.
        ends = F.when(F.col("hit.words") / 2 <= left, 1).otherwise(0) if shift == 0 else F.lit(0)
        state = stored(joined.select("skey", "docs", left.alias("open_words"), (prefix + F.coalesce(ends, F.lit(0))).cast("long").alias("prefix")))
    return sources.join(state.select("skey", F.col("prefix").alias("cut")), "skey")


def plan_mix(documents: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(sizes of all documents, one row per source with its target, tilt and cut); both written tables."""
    base = stored(documents.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("skey"), size_of(text_col).alias("size")))
    hist = stored(base.groupBy("skey", "size").agg(F.count("*").alias("n")))
    sources = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _ranked(sources).withColumn("weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")))
    sources = _balanced(hist, stored(_targets(stored(ranked), share, cap)), cap)
    total = sources.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    return base, stored(_cut(base, sources, total, cap))


_COLUMNS = ["size", "source_size", "target", "taken", "rate", "copies"]


def _applied(rows: DataFrame, sources: DataFrame, total: int, id_col: str, cap: float) -> DataFrame:
    out = lookup(rows, sources.select("skey", "docs", "source_size", "target", "full", "tilt", "mean", "cut"), ["skey"], "docs", total)
    out = out.withColumns(_drawn(cap, id_col)).withColumn("copies", F.col("whole") + F.coalesce((F.col("place") < F.col("cut")).cast("long"), F.lit(0)))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_sizes(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """How often each document is taken: ``doc_id, size, source_size, target, taken, rate, copies``, one row per input row.

    Sizes are numbers of words; null and empty texts have 0, are counted as documents and change no sum. Sources in order of
    code point, the null source last as one source of its own, weigh ``weights`` in turn and share ``share`` of all words;
    no target is above ``cap`` times its source. Within a source, document rates are tilted exponentially by size
    (entropy balancing) and rounded to copies so that the words taken meet the target as near as one document
    allows. The draw depends on the id alone, so reruns agree; rows that repeat an id are drawn together. An
    empty table gives an empty table. Per source the driver holds nothing; a large source is never moved to one task.
    """
    base, sources = plan_mix(documents, id_col, source_col, text_col, weights, share, cap)
    return _applied(base, sources, base.count(), "doc_id", cap).select("doc_id", *_COLUMNS)


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns. ``documents`` must be a written table.
    Texts of large sources stay where they are. Documents without words are taken once."""
    base, sources = plan_mix(documents, id_col, source_col, text_col, weights, share, cap)
    mine = documents.columns
    rows = documents.select(F.struct(*[F.col(c) for c in mine]).alias("__doc"), F.col(id_col).alias("__id"), source_key(source_col).alias("skey"), size_of(text_col).alias("size"))
    out = _applied(rows, sources, base.count(), "__id", cap)
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("__doc")[c].alias(c) for c in mine])


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
