"""Helpers that keep joins whole and balanced when one key holds much of the data.

* ``hot_keys`` finds heavy keys with a mergeable sketch: no shuffle of the keys
  themselves, a result of bounded size.
* ``left_join`` spreads the rows of heavy keys over several tasks.
* ``small`` marks a table for broadcast only after its size was checked.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this is split over several tasks.
HOT_ROWS = 2_000_000
# The sketch sees every key above rows / TRACKED; at most MAX_HOT are returned.
TRACKED = 50_000
MAX_HOT = 10_000
# The same for sketches that are kept beside a table, one a year.
KEPT = 4_000
MAX_WAYS = 4_096
# Largest table to broadcast, in rows and in bytes of text.
SMALL_ROWS = 200_000
SMALL_BYTES = 64 * 1024 * 1024


def hot_keys(
    df: DataFrame, key: str, hot_rows: int | None = HOT_ROWS, with_null: bool = False
) -> list[tuple[object, int]]:
    """Keys of ``df`` with more than ``hot_rows`` rows, with their estimated counts.

    One aggregate over the key column.  The list is short by construction and
    only steers the spreading of rows: a key missed here is joined like any
    other, so results never depend on the estimate.
    """
    return hot_keys_of(df, [key], hot_rows, with_null)[key]


def hot_keys_of(df: DataFrame, keys: list[str], hot_rows: int | None = HOT_ROWS, with_null: bool = False) -> dict[str, list[tuple[object, int]]]:
    """``hot_keys`` of several columns in one scan."""
    if hot_rows is None:
        return {k: [] for k in keys}
    sketches = [F.expr(f"approx_top_k(`{k}`, {MAX_HOT}, {TRACKED})").alias(f"t{i}") for i, k in enumerate(keys)]
    top = df.agg(*sketches).first()
    return {k: [(r["item"], r["count"]) for r in top[f"t{i}"] if r["count"] > hot_rows and (with_null or r["item"] is not None)] for i, k in enumerate(keys)}


def key_sketches(df: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Mergeable sketches of the frequent values of ``keys``, a column each; one row, or one per ``by``. They see every key above
    rows / ``KEPT``."""
    return df.groupBy(*([by] if by else [])).agg(*[F.expr(f"approx_top_k_accumulate(`{k}`, {KEPT})").alias(k) for k in keys])


def hot_of_sketches(sketches: DataFrame, key: str, hot_rows: int | None = HOT_ROWS, with_null: bool = False) -> list[tuple[object, int]]:
    """``hot_keys`` from the sketches of a table's parts; the table is not read."""
    if hot_rows is None:
        return []
    merged = sketches.agg(F.expr(f"approx_top_k_combine(`{key}`, {KEPT})").alias("t")).where("t is not null")
    top = merged.select(F.expr(f"approx_top_k_estimate(t, {KEPT})").alias("t")).first()
    return [(r["item"], r["count"]) for r in (top["t"] if top else []) if r["count"] > hot_rows and (with_null or r["item"] is not None)]


def left_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str | list[str],
    right_on: str | list[str] | None = None,
    *,
    hot_rows: int | None = HOT_ROWS,
    left_hot: list[tuple[object, int]] | None = None,
    right_hot: list[tuple[object, int]] | None = None,
) -> DataFrame:
    """Left join that survives heavy keys on either side; the right keys are not kept.

    A row of a heavy key gets a slot number (see ``_dealt``); the other side is repeated once
    per slot, for those keys only.  Equal rows are joined once a slot and repeated after the join.
    Rows without a key match nothing and do not move.  A heavy key of
    the right side has matches by definition, so a repeated left row that meets
    an empty slot is dropped and nothing is lost.

    Heavy keys are looked for in both tables unless they are given; a caller
    that knows a side to be unique, or derived, gives the list (or ``[]``).
    """
    left_keys = [left_on] if isinstance(left_on, str) else list(left_on)
    right_keys = left_keys if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    l = left.withColumn("__lkey", one_key(left_keys))
    r = right.withColumn("__rkey", one_key(right_keys)).drop(*right_keys)
    same_key = F.col("__lkey") == F.col("__rkey")
    if left_hot is None:
        left_hot = hot_keys(l, "__lkey", hot_rows, with_null=True)
    if right_hot is None:
        right_hot = hot_keys(r, "__rkey", hot_rows)
    if hot_rows is None or not (left_hot or right_hot):
        return l.join(r, same_key, "left").drop("__lkey", "__rkey")

    ways = F.broadcast(_ways(l, left_hot, right_hot, hot_rows))

    def with_ways(df: DataFrame, key: str) -> DataFrame:
        found = df.join(ways, F.col(key) == F.col("__hot"), "left").drop("__hot")
        return found.withColumns({w: F.coalesce(w, F.lit(1)) for w in ("__lways", "__rways")})

    def copies(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # Rows without a key match nothing: they need not move.
    without = l.where(F.col("__lkey").isNull()).drop("__lkey")
    without = without.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in r.schema.fields if f.name != "__rkey"])
    l = (
        _dealt(with_ways(l.where(F.col("__lkey").isNotNull()), "__lkey"), "__lways", "__ls", "__ln")
        .withColumn("__rs", copies("__rways"))
        .withColumn("__many", F.col("__rways") > 1)
        .drop("__lways", "__rways")
    )
    r = _dealt(with_ways(r, "__rkey"), "__rways", "__rs2", "__rn").withColumn("__ls2", copies("__lways")).drop("__lways", "__rways")
    joined = l.join(r, same_key & (F.col("__ls") == F.col("__ls2")) & (F.col("__rs") == F.col("__rs2")), "left")
    kept = joined.where(~F.col("__many") | F.col("__rkey").isNotNull())
    times = F.col("__ln") * F.coalesce("__rn", F.lit(1))
    again = kept.withColumn("__times", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    found = again.drop("__lkey", "__rkey", "__ls", "__rs", "__ls2", "__rs2", "__many", "__ln", "__rn", "__times")
    return found.unionByName(without)


def _dealt(df: DataFrame, ways: str, slot: str, number: str) -> DataFrame:
    """Each row with a slot below ``ways`` and the ``number`` of rows it stands for.

    Rows of heavy keys that are equal in all columns are counted, and their number is shared out over the slots, as evenly as it
    goes; the first slot comes from a hash of the row. So neither equal rows nor rows of one input split meet in one slot, and
    nothing depends on the order of rows: a task that is run again places them as before. Rows with columns that
    cannot be compared (maps, variants) get their slot from the others and from their split.
    """
    odd = [f.name for f in df.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    if odd:
        hashed = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns if c not in odd])
        return df.withColumn(slot, F.pmod(hashed, F.col(ways)).cast("int")).withColumn(number, F.lit(1).cast("long"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.where(F.col(ways) > 1).groupBy(*columns).agg(F.count("*").alias("__all"))
    parts = F.least(F.col("__all"), F.col(ways)).cast("int")
    shared = counted.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    first = F.pmod(F.xxhash64(*columns), F.col(ways))
    share = F.floor(F.col("__all") / parts) + (F.col("__part") < F.col("__all") % parts).cast("long")
    heavy = shared.select(*columns, F.pmod(first + F.col("__part"), F.col(ways)).cast("int").alias(slot), share.cast("long").alias(number))
    return df.where(F.col(ways) <= 1).select(*columns, F.lit(0).alias(slot), F.lit(1).cast("long").alias(number)).unionByName(heavy)


def one_key(keys: list[str]) -> Column:
    """The key itself, or several keys as one text that is null when any of them is."""
    if len(keys) == 1:
        return F.col(keys[0])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))


def _ways(l: DataFrame, left_hot: list, right_hot: list, hot_rows: int) -> DataFrame:
    """One row per heavy key (``MAX_HOT`` per side at most) with its slots in either table."""
    def slots(n: int) -> int:
        return min(MAX_WAYS, 2 * -(-n // hot_rows))

    ways: dict[object, list[int]] = {}
    for side, found in enumerate((left_hot, right_hot)):
        for key, n in found:
            if key is not None:
                ways.setdefault(key, [1, 1])[side] = slots(n)
    schema = T.StructType([T.StructField("__hot", l.schema["__lkey"].dataType), T.StructField("__lways", T.IntegerType()), T.StructField("__rways", T.IntegerType())])
    return l.sparkSession.createDataFrame([(k, *w) for k, w in ways.items()], schema)


def small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast when a count shows it to be small, else ``df`` as it is.

    Unmarked tables are left to the planner (sort-merge join, runtime skew split).
    """
    text = [F.coalesce(F.octet_length(F.col(c.name).cast("string")), F.lit(0)) for c in df.schema.fields]
    width = sum(text[1:], text[0]) if text else F.lit(0)
    seen = df.select(width.alias("b")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    fits = seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes
    return F.broadcast(df) if fits else df


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", also: Column | None = None) -> DataFrame:
    """Join on keys where null equals null (``also`` adds a condition); the keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = also
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def ensure_checkpoint_dir(spark) -> None:
    """Use the checkpoint folder the cluster names; make one only on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinpanel-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark) -> str:
    """Name of a new folder that all executors see, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
