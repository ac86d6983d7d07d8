"""Exact quantiles that never gather a large group's values in one place.

Groups are measured first.  When the largest is small enough for one task the
built-in percentile is used.  Beyond that, quantiles are found by selection,
guided by a sketch: a mergeable sketch of the values left gives two values that
stand closely around each wanted rank; one pass then counts exactly how many
values lie below, at, between and above them, which solves the rank or narrows
it to what lies strictly between.  The sketch only guides, the counts decide, so
an interval shrinks by the same factor whatever the values are: outliers of any
size and values that fill half of a group cost no more passes.  This goes on
until what is left of every interval fits a task, where its values are counted.
Sketches and counts are combined map-side: a pass moves a few rows per group and
task, whatever the size of the group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.operators.scale import SMALL_BYTES, SMALL_ROWS, attach, shared_folder

# Steps of the grid that a sketch is asked for, and its accuracy: ranks are off
# by a 1/ACCURACY of the values at most.
GRID, ACCURACY = 512, 10_000
# Up to this many values a group may be gathered by one task.
GROUP_ROWS = 1_000_000
# A task holds the values of up to 128 groups before it turns to sorting; all of
# them together stay below this (about 1 GB).
TASK_GROUPS = 128
TASK_ROWS = 16_000_000


@dataclass(frozen=True)
class Sizes:
    """Number of groups, values in the largest one, bytes of all group keys."""

    groups: int
    largest: int
    key_bytes: int

    @property
    def fit_a_task(self) -> bool:
        return self.largest <= GROUP_ROWS and self.largest * min(self.groups, TASK_GROUPS) <= TASK_ROWS

    @property
    def fit_a_broadcast(self) -> bool:
        return self.groups <= SMALL_ROWS and self.key_bytes <= SMALL_BYTES


def group_sizes(df: DataFrame, by: list[str], value: str) -> Sizes:
    """Measured with one aggregate over the group columns."""
    width = sum([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in by], F.lit(0))
    row = (
        df.groupBy(*by).agg(F.count(value).alias("n"))
        .agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.sum(width).alias("bytes"))
        .first()
    )
    return Sizes(row["groups"], row["largest"] or 0, row["bytes"] or 0)


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    quantiles: dict[str, float],
    *,
    method: str = "auto",
    sizes: Sizes | None = None,
    fit: int = GROUP_ROWS,
    grid: int = GRID,
    passes: list[int] | None = None,
) -> DataFrame:
    """One row per group with the quantiles asked for, linearly interpolated.

    ``method`` is ``auto`` (by the size of the largest group), ``builtin`` or
    ``selection``.  Groups without a value have no row.  Selection narrows until
    at most ``fit`` values are left around a rank; ``passes``, if given, receives
    that number before each pass over the values.
    """
    x = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    if not by:
        return exact_quantiles(
            x.withColumn("__all", F.lit(0)), ["__all"], "__v", quantiles, method=method, fit=fit, grid=grid, passes=passes
        ).drop("__all")
    if method not in ("auto", "builtin", "selection"):
        raise ValueError(f"unknown method {method!r}")
    if method != "builtin":
        sizes = sizes or group_sizes(x, by, "__v")
        method = "builtin" if method == "auto" and sizes.fit_a_task else "selection"
    if method == "builtin":
        return x.groupBy(*by).agg(*[F.percentile("__v", F.lit(p)).alias(name) for name, p in quantiles.items()])

    mark = F.broadcast if sizes.fit_a_broadcast else _as_is
    found = _select(x, by, list(quantiles.values()), mark, fit, grid, passes)
    out = []
    for i, (name, p) in enumerate(quantiles.items()):
        below, above = F.col(f"__v{2 * i}"), F.col(f"__v{2 * i + 1}")
        # The weights the built-in percentile uses, so that both ways give the same bits.
        lower, upper, at = _ends(p)
        out.append(F.when(below == above, below).otherwise((upper - at) * below + (at - lower) * above).alias(name))
    return found.select(*by, *out)


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _ends(p: float) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and place of quantile ``p`` among ``__n`` values."""
    h = (F.col("__n") - 1) * F.lit(p)
    return F.floor(h), F.ceil(h), h


def _written(df: DataFrame) -> DataFrame:
    """A row per group, kept on disk: plans of later passes start from it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _select(x: DataFrame, by: list[str], probs: list[float], mark, fit: int, grid: int, passes: list[int] | None) -> DataFrame:
    """``__n`` and the values ``__v0``, ``__v1``, ... at the lower and upper rank of each quantile, a row per group.

    Of rank i, ``__l`` and ``__h`` are the values it lies strictly between (null: no bound), ``__b`` the number of values up to
    ``__l``, ``__m`` the number strictly between; ``__v`` is its value once it is known.
    """
    ranks = [rank for p in probs for rank in _ends(p)[:2]]
    every = range(len(ranks))
    state = x.groupBy(*by).agg(F.count("*").alias("__n"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    state = _written(state.select(*by, "__n", *[c for i in every for c in (none.alias(f"__l{i}"), none.alias(f"__h{i}"), zero.alias(f"__b{i}"), F.col("__n").alias(f"__m{i}"), none.alias(f"__v{i}"))]))
    open_ = [F.col(f"__v{i}").isNull() for i in every]
    inside = [open_[i] & _above(F.col(f"__l{i}")) & _below(F.col(f"__h{i}")) for i in every]
    first = True
    while True:
        largest = state.agg(F.max(F.greatest(*[F.when(o, F.col(f"__m{i}")).otherwise(0) for i, o in enumerate(open_)], F.lit(0)))).first()[0] or 0
        if passes is not None:
            passes.append(largest)
        if largest <= fit:
            break
        steps = F.lit([k / grid for k in range(grid + 1)]).cast("array<double>")
        # At first all ranks lie in one interval, whose sketch serves them all.
        asked = [0] if first else list(every)
        sketches = attach(x, mark(state), by, "inner").groupBy(*by).agg(*[F.percentile_approx(F.when(inside[i], F.col("__v")), steps, F.lit(ACCURACY)).alias(f"__s{i}") for i in asked])
        cut = attach(state, sketches, by, "inner")
        state = _written(_narrowed(x, by, cut, ranks, inside, grid, mark, {i: 0 if first else i for i in every}))
        first = False
    return _counted(x, by, state, ranks, inside, mark)


def _above(bound: Column) -> Column:
    return bound.isNull() | (F.col("__v") > bound)


def _below(bound: Column) -> Column:
    return bound.isNull() | (F.col("__v") < bound)


def _narrowed(x: DataFrame, by: list[str], cut: DataFrame, ranks: list[Column], inside: list[Column], grid: int, mark, sketch: dict[int, int]) -> DataFrame:
    """The state after one exact count around the values that the sketches propose."""
    bounds = {}
    for i, rank in enumerate(ranks):
        cuts = F.col(f"__s{sketch[i]}")
        place = (rank - F.col(f"__b{i}")) / F.greatest(F.col(f"__m{i}"), F.lit(1))
        for side, step in (("p", F.floor((place - 1 / ACCURACY) * grid)), ("q", F.ceil((place + 1 / ACCURACY) * grid))):
            at = F.least(F.greatest(step, F.lit(0)), F.lit(grid)).cast("int") + 1
            bounds[f"__{side}{i}"] = F.when(F.col(f"__v{i}").isNull() & cuts.isNotNull(), F.element_at(cuts, at))
    keep = [c for c in cut.columns if not c.startswith("__s")]
    around = cut.select(*keep, *[v.alias(k) for k, v in bounds.items()])
    v = F.col("__v")
    counts = []
    for i in range(len(ranks)):
        p, q = F.col(f"__p{i}"), F.col(f"__q{i}")
        for name, where in (("c0", v < p), ("c1", v == p), ("c2", (v > p) & (v < q)), ("c3", (v == q) & (q > p))):
            counts.append(F.count_if(inside[i] & where).alias(f"__{name}_{i}"))
    told = attach(attach(x, mark(around), by, "inner").groupBy(*by).agg(*counts), around, by, "inner")
    out = [*by, "__n"]
    for i, rank in enumerate(ranks):
        lo, hi, below, m, known, p, q, c0, c1, c2, c3 = (F.col(f"__{k}{i}") for k in ("l", "h", "b", "m", "v", "p", "q", "c0_", "c1_", "c2_", "c3_"))
        r = rank - below
        ends = [c0, c0 + c1, c0 + c1 + c2, c0 + c1 + c2 + c3]
        cell = F.when(known.isNotNull(), -1).when(r < ends[0], 0).when(r < ends[1], 1).when(r < ends[2], 2).when(r < ends[3], 3).otherwise(4)
        pick = lambda *options, cell=cell: F.when(cell == 0, options[0]).when(cell == 2, options[1]).when(cell == 4, options[2])
        still = cell < 0
        out += [
            F.when(still, lo).otherwise(pick(lo, p, q)).alias(f"__l{i}"),
            F.when(still, hi).otherwise(pick(p, q, hi)).alias(f"__h{i}"),
            F.when(still, below).otherwise(pick(below, below + ends[1], below + ends[3])).alias(f"__b{i}"),
            F.when(still, m).otherwise(F.coalesce(pick(c0, c2, m - ends[3]), F.lit(0))).cast("bigint").alias(f"__m{i}"),
            F.when(still, known).when(cell == 1, p).when(cell == 3, q).alias(f"__v{i}"),
        ]
    return told.select(*out)


def _counted(x: DataFrame, by: list[str], state: DataFrame, ranks: list[Column], inside: list[Column], mark) -> DataFrame:
    """Ranks still open are read off their values, counted and put in order."""
    # Ranks in one interval share its values.
    same = lambda i, j: F.col(f"__l{i}").eqNullSafe(F.col(f"__l{j}")) & F.col(f"__h{i}").eqNullSafe(F.col(f"__h{j}")) & F.col(f"__v{j}").isNull()
    lead = [F.coalesce(*[F.when(same(i, j), F.lit(j)) for j in range(i)], F.lit(i)) for i in range(len(ranks))]
    which = F.array(*[F.when(c & (lead[i] == i), F.lit(i)) for i, c in enumerate(inside)])
    rows = attach(x, mark(state), by, "inner").select(*by, "__v", F.explode(F.array_compact(which)).alias("__i"))
    cells = rows.groupBy(*by, "__i", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(*[F.struct(lead[i].alias("__i"), F.lit(i).alias("__k"), (rank - F.col(f"__b{i}")).alias("__r")) for i, rank in enumerate(ranks)])
    wanted = state.select(*by, F.explode(wanted).alias("w")).select(*by, "w.*")
    placed = attach(cells.withColumn("__t", upto), wanted, [*by, "__i"], "inner").filter((F.col("__r") >= F.col("__t") - F.col("__c")) & (F.col("__r") < F.col("__t")))
    values = placed.groupBy(*by).agg(*[F.max(F.when(F.col("__k") == i, F.col("__v"))).alias(f"__w{i}") for i in range(len(ranks))])
    out = attach(state, values, by, "left")
    return out.select(*by, "__n", *[F.coalesce(f"__v{i}", f"__w{i}").alias(f"__v{i}") for i in range(len(ranks))])
