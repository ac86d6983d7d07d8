"""Counts, shares, sequences and timing over an event table ``(event_type, PNR, year, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.functions.dates import age_band, day_number, from_day_number
from kinpanel.operators.quantiles import exact_quantiles
from kinpanel.operators.scale import attach, small

MAX_TYPES = 1_000


def event_types(events: DataFrame, column: str = "event_type", at_most: int = MAX_TYPES) -> list:
    """Distinct values that become columns; refused when there are too many."""
    found = [r[0] for r in events.where(F.col(column).isNotNull()).select(column).distinct().limit(at_most + 1).collect()]
    if len(found) > at_most:
        raise ValueError(f"more than {at_most} values in {column}; they cannot all become columns")
    return sorted(found)


def event_counts(events: DataFrame, ordered: bool = False) -> DataFrame:
    counts = events.groupBy("event_type").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "event_type") if ordered else counts


def event_timing(events: DataFrame, when: str | None = None) -> DataFrame:
    """min, max, mean and median of the event date (or year) per type; means of dates are dates."""
    when = when or ("event_date" if "event_date" in events.columns else "year")
    dated = dict(events.dtypes)[when] == "date"
    number = day_number(when) if dated else F.col(when).cast("double")
    x = events.select("event_type", number.cast("double").alias("x"))
    base = x.groupBy("event_type").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    out = attach(base, exact_quantiles(x, ["event_type"], "x", {"median": 0.5}), ["event_type"])
    if dated:
        return out.select("event_type", *[from_day_number(F.col(c)).alias(c) for c in ("min", "max", "mean", "median")])
    return out


def event_dates(events: DataFrame, when: str = "event_date") -> DataFrame:
    return events.select(when if when in events.columns else "year", "event_type")


def event_summary(events: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """count, % of cohort and % of events per event type and per value of each category column."""
    columns = ["event_type", *(categories or [])]
    persons = events.agg((F.count_distinct("PNR") + F.max(F.when(F.col("PNR").isNull(), 1).otherwise(0))).alias("n")).scalar()
    counted = events.agg(F.count("PNR").alias("n")).scalar()
    long = events.select("PNR", *[F.col(c).cast("string").alias(f"__{c}") for c in columns]).unpivot(
        "PNR", [f"__{c}" for c in columns], "category", "value"
    )
    n = F.col("count")
    return (
        long.groupBy(F.substr("category", F.lit(3)).alias("category"), "value")
        .agg(F.count("PNR").alias("count"))
        .select("category", "value", "count", (n / persons * 100).alias("pct_cohort"), (n / counted * 100).alias("pct_total"))
        .orderBy("category", F.desc("count"), "value")
    )


def event_frequency(events: DataFrame, by: str | Column, name: str | None = None) -> DataFrame:
    """Events per group and type, groups in order, most frequent type first."""
    group = F.col(by) if isinstance(by, str) else by
    label = name or (by if isinstance(by, str) else "group")
    return (
        events.groupBy(group.alias(label), "event_type")
        .agg(F.count("PNR").alias("event_count"))
        .orderBy(label, F.desc("event_count"), "event_type")
    )


def age_band_frequency(events: DataFrame) -> DataFrame:
    return event_frequency(events, age_band("age"), "age_group")


def frequency_analysis(events: DataFrame, categories: list[str] | None = None) -> dict[str, DataFrame]:
    """The yearly, age-band and per-category frequency tables; age bands need a column ``age``."""
    tables = {"yearly_frequency": event_frequency(events, "year")}
    if "age" in events.columns:
        tables["age_group_frequency"] = age_band_frequency(events)
    for c in categories or []:
        tables[f"{c}_frequency"] = event_frequency(events, c)
    return tables


def with_group_count(events: DataFrame) -> DataFrame:
    """Each event row with the number of events of its year and type.

    The counts are joined back instead of taken over a window, so a year with
    very many events is not moved into one task.
    """
    counts = small(events.groupBy("year", "event_type").agg(F.count("PNR").alias("count")))
    return attach(events, counts, ["year", "event_type"])


def count_matrix(events: DataFrame, rows: str = "year", columns: str = "event_type", values: list | None = None) -> DataFrame:
    """Counts with one column per value; absent combinations are zero."""
    values = values if values is not None else event_types(events, columns)
    return events.groupBy(rows).pivot(columns, values).count().na.fill(0, [str(v) for v in values])


def count_long(events: DataFrame, rows: str = "year", columns: str = "event_type") -> DataFrame:
    """Counts as (row, value, count), without a limit on values; combinations without rows are absent."""
    return events.groupBy(rows, columns).agg(F.count("*").alias("count"))


#: Types are dealt into so many blocks; pairs of blocks are as many keys as its square.
PAIR_BLOCKS = 64


def event_correlation(events: DataFrame, types: list[str] | None = None, blocks: int = PAIR_BLOCKS) -> DataFrame:
    """Pearson correlation of the per-person counts for every pair of event types.

    ``correlation`` is null where a type has the same count for everyone. Types are rows, not columns: counts per person and
    type, products over the pairs of types a person really has, then one row per pair. Types are dealt into ``blocks`` by hash;
    each pair of blocks is a key of its own, so the pairs are made in as many places and no task or row holds all types.
    """
    counts = events.groupBy("PNR", "event_type").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    persons = counts.select("PNR").distinct().agg(F.count("*").cast("decimal(38,0)")).scalar()
    own = counts.where(F.col("event_type").isNotNull())
    if types is not None:
        own = own.where(F.col("event_type").isin(types))
    right = own.select(F.col("PNR").alias("__p"), F.col("event_type").alias("event_b"), F.col("n").alias("m"))
    both = own.withColumnRenamed("event_type", "event_a").join(right, F.col("PNR").eqNullSafe(F.col("__p")))
    products = both.groupBy("event_a", "event_b").agg(F.sum(F.col("n") * F.col("m")).alias("product"))
    sums = own.groupBy("event_type").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    if types is not None:  # a type asked for that nobody has is a row too
        wanted = events.sparkSession.createDataFrame([(t,) for t in types], "event_type string")
        sums = wanted.join(sums, "event_type", "left").na.fill(0)
        sums = sums.select("event_type", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("s", "q")])
    dealt = sums.withColumn("block", F.pmod(F.xxhash64("event_type"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = dealt.select(F.col("event_type").alias("event_a"), F.col("s").alias("s_a"), F.col("q").alias("q_a"), F.col("block").alias("i"), other.alias("j"))
    second = dealt.select(F.col("event_type").alias("event_b"), F.col("s").alias("s_b"), F.col("q").alias("q_b"), F.col("block").alias("j"), other.alias("i"))
    pairs = first.hint("shuffle_merge").join(second, ["i", "j"])
    n = persons

    def spread(x: str) -> Column:
        return (n * F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}")).cast("double")

    together = (n * F.coalesce("product", F.lit(0)) - F.col("s_a") * F.col("s_b")).cast("double")
    correlation = F.try_divide(together, F.sqrt(spread("a")) * F.sqrt(spread("b")))
    return pairs.join(products, ["event_a", "event_b"], "left").select("event_a", "event_b", correlation.alias("correlation"))


def event_share(events: DataFrame, group: str, column: str = "event_type") -> DataFrame:
    """Share of each group in the events of a type: the shares of a type sum to one."""
    counts = events.groupBy(group, column).agg(F.count("*").alias("count"))
    totals = small(events.groupBy(column).agg(F.count("*").alias("__total")))
    return attach(counts, totals, [column]).select(group, column, "count", (F.col("count") / F.col("__total")).alias("share"))


def event_flows(events: DataFrame, top_n: int = 5, min_count: int = 10, aggregate: bool = True) -> DataFrame:
    """Transitions between neighbouring events in the sequences shared by ``min_count`` persons or more.

    A person's sequence is ordered by year, then type.  It is held as runs
    (type, length), one per year and type at most, so its size does not depend
    on how many events a person has.  Types outside the ``top_n`` become
    "Other"; neighbours that are equal then are no transition.
    """
    runs = events.groupBy("PNR", "year", "event_type").agg(F.count("*").alias("n"))
    steps = runs.groupBy("PNR").agg(F.array_sort(F.collect_list(F.struct("year", "event_type", "n"))).alias("steps"))
    empty = F.lit(None).cast("array<struct<event_type:string,n:bigint>>")

    def add(done: Column, step: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        event_type, n = step["event_type"].cast("string"), step["n"]
        longer = F.struct(event_type.alias("event_type"), (last["n"] + n).alias("n"))
        new = F.array(F.struct(event_type.alias("event_type"), n.alias("n")))
        same = last["event_type"].eqNullSafe(event_type) & (F.size(done) > 0)
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, new))

    start = F.coalesce(empty, F.array().cast("array<struct<event_type:string,n:bigint>>"))
    sequences = (
        steps.select(F.aggregate("steps", start, add).alias("sequence"))
        .groupBy("sequence")
        .agg(F.count("*").alias("value"))
        .where(F.col("value") >= min_count)
    )
    types = F.transform("sequence", lambda s: s["event_type"])
    neighbours = F.arrays_zip(F.slice("types", 1, F.size("types") - 1).alias("source"), F.slice("types", 2, F.size("types")).alias("target"))
    pairs = (
        sequences.select("value", types.alias("types"))
        .where(F.size("types") > 1)
        .select("value", F.explode(neighbours).alias("pair"))
        .select("pair.source", "pair.target", "value")
    )
    # At most top_n rows.
    top = events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(top_n)
    for end in ("source", "target"):
        named = F.broadcast(top.select(F.col("event_type").alias("__top")))
        pairs = pairs.join(named, F.col(end) == F.col("__top"), "left").withColumn(
            end, F.when(F.col("__top").isNotNull(), F.col(end)).otherwise("Other")
        ).drop("__top")
    flows = pairs.where(F.col("source") != F.col("target"))
    if not aggregate:
        return flows.select("source", "target", "value")
    return flows.groupBy("source", "target").agg(F.sum("value").alias("value"))


def time_to_event(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Years from the first year of the table to a person's first event of a type, with the number of events."""
    start = events.agg(F.min("year").alias("y")).scalar()
    rows = events if event_type is None else events.where(F.col("event_type") == event_type)
    return (
        rows.groupBy("event_type", "PNR")
        .agg((F.min("year") - start).cast("int").alias("time_to_event"), F.count("PNR").alias("events"))
        .where(F.col("PNR").isNotNull() & F.col("time_to_event").isNotNull())
    )
