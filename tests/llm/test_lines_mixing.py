"""Line deduplication and mixing."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinpanel.llm import lines, mixing
from tests.llm.conftest import ODD
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_lines_equal_sql(spark):
    ok, message = compare(spark, connect("/root/testdata/sf0.01"), lines.op6_line_dedup, lines.LINE_SQL, "/root/testdata/sf0.01")
    assert ok, message


def test_lines_equal_brute_force(spark):
    rows = [(i, f"host{i % 3}" if i % 7 else None, f"own {i}\nmenu\n\nfooter {i % 2}\nmenu" if i % 5 else None) for i in range(80)]
    rows += [(100, "single", "menu"), (101, "host1", ""), (101, "host1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pages, seen = Counter(), Counter()
    for _, host, text in rows:
        if text is not None:
            pages[host] += 1
            for line in set(text.split("\n")):
                seen[host, line] += bool(line.strip(" "))
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    want = Counter((d, h, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for d, h, t in rows)
    got = lines.dedup_lines(docs, "source", "text").collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == want
    assert all(r.n_lines == (0 if r.text is None else r.n_lines) for r in got)


def test_lines_keep_rows_and_columns(odd, none, clash):
    assert lines.dedup_lines(none, "source", "text").count() == 0
    got = lines.dedup_lines(clash, "source", "text")
    assert got.count() == len(ODD) and set(got.columns) == set(clash.columns) | {"n_dropped"}
    assert got.select("lines", "pages", "host_key").distinct().collect() == [("x", "x", "x")]
    assert lines.dedup_lines(odd, "source", "text").filter("n_dropped > 0").count() == 0


def _waterfill(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, share * sum(sizes.values())
    while open_:
        each = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if each[s] > cap * sizes[s]]
        if not above:
            return target | each
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("sf", [SF])
def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("source"))
    rows = mixing.mix_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    target = _waterfill(sizes)
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1, s
    again = mixing.mix_sizes(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r.doc_id, r.taken) for r in rows)


def test_rates_are_tilted_by_size(spark):
    """The dual's optimum: rates are exp(tilt * size) stopped at the cap, one tilt a source."""
    import math

    docs = spark.createDataFrame([(i, "w " * (1 + i % 13), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_sizes(docs).collect()
    for source in (0, 1):
        mine = [r for r in rows if r.doc_id % 2 == source and r.rate < 2]
        tilts = [math.log(r.rate) / r.size for r in mine]
        assert not mine or max(tilts) - min(tilts) < 1e-9
        assert abs(sum(r.rate * r.size for r in rows if r.doc_id % 2 == source) - next(r.target for r in rows if r.doc_id % 2 == source)) < 1


def test_mix_repeats_documents(spark, odd_path):
    docs = spark.read.parquet(f"{odd_path}/documents.parquet")
    sizes = mixing.mix_sizes(docs)
    assert sizes.count() == len(ODD)
    want = Counter()
    for r in sizes.collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert got == +want and mixing.mix(docs).columns == docs.columns


def test_mix_of_nothing(none, clash):
    assert mixing.mix_sizes(none).count() == 0
    assert mixing.mix_sizes(clash).count() == len(ODD)
