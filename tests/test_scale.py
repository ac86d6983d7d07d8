"""Heavy keys: the spread paths give the same rows as brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinpanel.operators.event_reports import event_flows
from kinpanel.operators.ordered import with_previous
from kinpanel.operators.quantiles import exact_quantiles
from kinpanel.operators.scale import hot_keys, left_join, small


def _left(spark):
    data = [(str(i), i) for i in range(40)] + [(None, 100 + i) for i in range(30)] + [("7", 200 + i) for i in range(60)] + [("nobody", 999)]
    return spark.createDataFrame(data, "k string, a int").repartition(5)


def _right(spark):
    data = [("7", i) for i in range(80)] + [(str(i), i) for i in range(0, 40, 3)] + [(None, -1)] * 20 + [("9", 5)] * 50
    return spark.createDataFrame(data, "rk string, b int").repartition(6)


def _brute(left, right):
    by_key = defaultdict(list)
    for r in right.collect():
        by_key[r["rk"]].append(r["b"])
    out = []
    for l in left.collect():
        matches = by_key.get(l["k"]) if l["k"] is not None else None
        out += [(l["k"], l["a"], b) for b in matches] if matches else [(l["k"], l["a"], None)]
    return out


@pytest.mark.parametrize("given", [{}, {"left_hot": []}, {"right_hot": []}, {"left_hot": [("7", 61), (None, 30)], "right_hot": [("9", 50)]}])
@pytest.mark.parametrize("hot_rows", [None, 10, 25, 10_000])
def test_left_join_equals_brute_force(spark, given, hot_rows):
    left, right = _left(spark), _right(spark)
    got = left_join(left, right, "k", "rk", hot_rows=hot_rows, **given)
    assert got.columns == ["k", "a", "b"]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_brute(left, right), key=key)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_left_join_on_several_keys(spark, hot_rows):
    left = spark.createDataFrame([("a", 1, "l1"), ("a", 2, "l2"), (None, 1, "l3"), ("b", 1, "l4")], "k string, y int, l string")
    right = spark.createDataFrame([("a", 1, i) for i in range(50)] + [("b", 2, 0), (None, 1, 7), ("a", None, 8)], "k string, y int, r int").repartition(4)
    got = left_join(left, right, ["k", "y"], hot_rows=hot_rows)
    assert got.columns == ["k", "y", "l", "r"]
    counts = {r["l"]: (r["n"], r["m"]) for r in got.groupBy("l").agg(F.count("*").alias("n"), F.count("r").alias("m")).collect()}
    assert counts == {"l1": (50, 50), "l2": (1, 0), "l3": (1, 0), "l4": (1, 0)}


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(0, 20_000, 1, 16).select(F.lit(None).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(1, "x")], "rk int, v string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        joined = left_join(left, right, "k", "rk", hot_rows=1_000)
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 * 1024 * 1024)
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(per_task) == 20_000 and max(per_task) < 15_000


def test_left_join_spreads_a_heavy_key(spark):
    right = spark.range(0, 20_000, 1, 16).select(F.lit(1).alias("rk"), "id")
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        joined = left_join(left, right, "k", "rk", hot_rows=1_000)
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 * 1024 * 1024)
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(per_task) == 20_001
    assert max(per_task) < 15_000


def test_hot_keys_lists_only_heavy_ones(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 5 + [(None,)] * 40, "k string")
    assert hot_keys(df, "k", 10) == [("a", 50)]
    assert dict(hot_keys(df, "k", 10, with_null=True)) == {"a": 50, None: 40}
    assert hot_keys(df, "k", None) == []
    assert hot_keys(df.where("false"), "k", 1) == []


def test_small_checks_rows_and_bytes(spark):
    df = spark.range(100)
    assert small(df, max_rows=100) is not df
    assert small(df, max_rows=99) is df
    assert small(df, max_bytes=10) is df


def _panel(spark, n=3_000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        person = "heavy" if i % 3 == 0 else None if i % 7 == 0 else f"p{rng.randrange(40)}"
        rows.append((person, rng.randrange(2000, 2004), rng.choice([None, 1, 2]), rng.choice(["x", "y", None]), rng.randrange(5), i % 4))
    return spark.createDataFrame(rows, "person string, year int, month int, kom string, size int, other int").repartition(7)


@pytest.mark.parametrize("hot_rows", [50, 500, 10_000])
def test_previous_row_equals_brute_force(spark, hot_rows):
    df = _panel(spark)
    got = with_previous(df, "person", ["year", "month"], ["kom", "size"], hot_rows)
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["person"]].append(r)
    none_first = lambda *v: tuple((x is not None, x if x is not None else 0) for x in v)
    expected = []
    for rows in groups.values():
        rows.sort(key=lambda r: none_first(r["year"], r["month"]) + (((r["kom"] is not None), r["kom"] or ""), (True, r["size"])))
        for i, r in enumerate(rows):
            # Rows without a person are nobody's: they have no row before them.
            before = (rows[i - 1]["kom"], rows[i - 1]["size"]) if i and r["person"] is not None else None
            # Rows equal in everything that is ordered may change places.
            expected.append((r["person"], r["year"], r["month"], r["kom"], r["size"], before))
    ours = [(r["person"], r["year"], r["month"], r["kom"], r["size"], tuple(r["previous"]) if r["previous"] else None) for r in got.collect()]
    assert sorted(ours, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("hot_rows", [None, 40])
def test_previous_row_within_a_register(spark, hot_rows):
    rows = [("p", reg, y, y * 10 + i) for i, reg in enumerate("ab") for y in range(60)]
    df = spark.createDataFrame(rows, "person string, register string, year int, v int").repartition(5)
    got = with_previous(df, "person", ["year"], ["v"], hot_rows, ["register"]).collect()
    assert len(got) == 120
    for r in got:
        assert (r["previous"]["v"] if r["previous"] else None) == (r["v"] - 10 if r["year"] else None)


@pytest.mark.parametrize("fit,grid", [(0, 4), (8, 16), (1_000_000, 512)])
def test_quantiles_equal_numpy(spark, fit, grid):
    rng = np.random.default_rng(3)
    data = {
        "even": rng.normal(0, 1, 501).tolist(),
        "tail": (10 ** rng.uniform(-3, 12, 400)).tolist(),
        "ties": [5.0] * 300 + [1.0, 9.0],
        "one": [42.0],
        "gap": [None, 1.0, None, 3.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("empty", None)], "g string, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, method="selection", fit=fit, grid=grid).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        values = [v for v in vs if v is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-12)


def test_large_groups_are_selected(spark, monkeypatch):
    from kinpanel.operators import quantiles as q

    df = spark.range(1000).selectExpr("id % 2 as g", "cast(id as double) v")
    sizes = q.group_sizes(df, ["g"], "v")
    assert (sizes.groups, sizes.largest) == (2, 500) and sizes.fit_a_task and sizes.fit_a_broadcast
    small_plan = exact_quantiles(df, ["g"], "v", {"m": 0.5})
    monkeypatch.setattr(q, "GROUP_ROWS", 100)
    large_plan = exact_quantiles(df, ["g"], "v", {"m": 0.5})
    assert "percentile" in small_plan._jdf.queryExecution().toString()
    assert "percentile" not in large_plan._jdf.queryExecution().toString()
    assert sorted(map(tuple, small_plan.collect())) == sorted(map(tuple, large_plan.collect()))
    monkeypatch.setattr(q, "SMALL_ROWS", 1)
    unmarked = exact_quantiles(df, ["g"], "v", {"m": 0.5})
    assert sorted(map(tuple, unmarked.collect())) == sorted(map(tuple, large_plan.collect()))
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], "v", {"m": 0.5}, method="other")


@pytest.mark.parametrize("method", ["auto", "builtin", "selection"])
def test_quantiles_without_groups(spark, method):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.25}, method=method).collect() == [(5.0, 2.5)]


def test_tiers_of_outliers_cost_no_more_passes(spark):
    """Values over 300 powers of ten, and one that fills a third of its group: every pass leaves a hundredth or less."""
    rng = np.random.default_rng(8)
    far = [rng.normal(0, 1, 6000), 1e6 * rng.uniform(1, 2, 3000), 1e18 * rng.uniform(1, 2, 2000), 1e300 * rng.uniform(0, 1, 900), [float("inf")] * 5, [-1e200] * 200]
    data = {"far": np.concatenate(far), "tied": np.concatenate([np.full(7000, 2.5), rng.uniform(2.4, 2.6, 9000)]), "few": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double").repartition(5)
    probs, passes = {"a": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 0.995}, []
    got = exact_quantiles(df, ["g"], "v", probs, method="selection", fit=20, passes=passes)
    assert sorted(got.collect()) == sorted(exact_quantiles(df, ["g"], "v", probs, method="builtin").collect())
    assert passes[0] == 16_000 and 2 <= len(passes) <= 4 and passes[-1] <= 20 and all(b <= a / 100 or b <= 20 for a, b in zip(passes, passes[1:]))


@pytest.mark.parametrize("method", ["auto", "selection"])
def test_quantiles_of_null_group_and_infinite_values(spark, method):
    rows = [(None, 1.0), (None, 3.0), ("a", float("inf")), ("a", 2.0), ("a", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}, method=method).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_flows_hold_runs_not_rows(spark):
    """A person with very many equal events has the sequence of one run."""
    rows = [("big", 2000, "a")] * 5_000 + [("big", 2001, "b")] * 5_000 + [("p", 2000, "a"), ("p", 2001, "b"), ("q", 1999, "a"), ("q", 2001, "b")]
    df = spark.createDataFrame(rows, "PNR string, year int, event_type string")
    assert {tuple(r) for r in event_flows(df, min_count=2).collect()} == {("a", "b", 2)}
    assert {tuple(r) for r in event_flows(df, min_count=1).collect()} == {("a", "b", 3)}


@pytest.mark.parametrize("place", ["one split", "after a shuffle on the key"])
def test_clustered_heavy_key_is_spread(spark, place):
    """All rows of the heavy key come from one split, or were shuffled to one task by an earlier step."""
    from pyspark.sql import functions as F

    from kinpanel.operators.scale import left_join

    n = 40_000
    left = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    left = left.coalesce(1) if place == "one split" else left.repartition(8, "k")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, w string")
    joined = left_join(left, right, "k", hot_rows=2000)
    with_adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_adaptive)
    assert sum(sizes) == 2 * n and max(sizes) < 2 * n / 3


@pytest.mark.parametrize("side", ["left", "right"])
def test_equal_heavy_rows_are_spread(spark, side):
    """One split holds very many equal rows of one key; they are joined, and made again, in many tasks."""
    from pyspark.sql import functions as F

    from kinpanel.operators.scale import left_join

    n = 40_000
    many = spark.range(n).select(F.lit(1).alias("k"), F.lit(-0.5).alias("v"), F.array(F.lit("x"), F.lit(None)).alias("a")).coalesce(1)
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (None, "n")], "k int, w string")
    left, right = (many, few) if side == "left" else (few, many)
    joined = left_join(left, right, "k", hot_rows=2000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2 * n + (3 if side == "right" else 0) and max(sizes) < 2 * n / 3
    want = left.join(right.withColumnRenamed("k", "__k"), F.col("k") == F.col("__k"), "left").drop("__k")
    order = sorted(want.columns)
    count = lambda df: sorted(map(str, df.groupBy(*order).count().collect()))
    assert joined.columns == want.columns and count(joined) == count(want)


def test_both_quantile_ways_give_the_same_bits(spark):
    import random

    from kinpanel.operators.quantiles import exact_quantiles

    rng = random.Random(3)
    rows = [(g, rng.random() * 10 ** rng.randrange(-3, 4)) for g in range(40) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.1}
    ways = [sorted(exact_quantiles(df, ["g"], "x", probs, method=m).collect()) for m in ("builtin", "selection")]
    assert ways[0] == ways[1]


def test_long_codes_and_names_are_whole(spark):
    from pyspark.sql import functions as F

    from kinpanel.functions.codes import without_prefix
    from kinpanel.operators.statistics import value_counts

    name = "c" * 1500
    df = spark.createDataFrame([("D" + "x" * 149,)], [name])
    assert len(df.select(without_prefix(F.col(name))).first()[0]) == 149
    assert value_counts(df, [name]).first()["column"] == name
