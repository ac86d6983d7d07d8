"""Exact, near, substring and vector duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinpanel.llm import exact, graph, jaccard, substrings, vectors
from tests.llm.conftest import ODD
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_equals_sql(spark):
    ok, message = compare(spark, connect(SF), exact.op3_exact_dedup, exact.EXACT_SQL, SF)
    assert ok, message


def test_exact_odd_rows(odd, none, clash):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == len(ODD)
    fox = [r for r in rows if r.group_size == 5]
    assert {r.keep_id for r in fox} == {1} and len(fox) == 5 and [r.doc_id for r in fox if r.kept] == [1]
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in empty if r.doc_id) == [4, 5] and len(empty) == 3 and sum(r.kept for r in empty) == 1
    assert exact.exact_groups(none).count() == 0 and exact.exact_groups(clash).count() == len(ODD)


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, "z")], "doc_id long, text string")
    got = Counter((r.doc_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect())
    assert got == {(1, 2, True): 1, (1, 2, False): 1, (1, 1, True): 1, (None, 2, True): 1, (None, 2, False): 1}


def test_texts_of_one_key_are_chained(spark):
    """A hash of few values puts different texts under one key; bytes tell them apart."""
    docs = spark.createDataFrame([(i, f"text {i % 6}") for i in range(60)], "doc_id long, text string")
    got = exact.exact_groups(docs, key=lambda c: F.pmod(F.length(c), F.lit(2)).cast("long")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (i % 6, 10) for i in range(60)}


def test_directory_doubles():
    cells = {0: 5, 1: 5, 2: 5, 40000: 3}
    parts = exact.directory(cells, 5)
    assert sum(1 << (exact.BITS - d) for _, d in parts) == 1 << exact.BITS
    starts = [s for s, _ in parts]
    held = Counter(np.searchsorted(starts, c, "right") - 1 for c in cells)
    assert max(held.values()) == 1 and exact.directory(cells, 100) == [(0, 0)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    want = _components({n for x in links for n in x}, links)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _near(rows):
    sets = [_shingles(t) for _, t in rows]
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 75 * len(x | sets[j]):
                links.append((i, j))
    comp = _components(range(len(rows)), links)
    least = defaultdict(list)
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c].append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min(least[c], default=None)) for i, c in comp.items())


def _edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[i], f"n{rng.randrange(10**6)}"]])
    return words


def test_near_equals_brute_force(spark):
    """Sets of all sizes, edited to both sides of the limit, groups of many copies, a passage that most texts share."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(25))
    texts = []
    for size in [1, 3, 5, 6, 7, 9, 12, 20, 33, 60, 90, 140, 200, 330]:
        for _ in range(3):
            words = [f"v{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for part in (0.01, 0.03, 0.05, 0.07):
                texts.append(" ".join(_edited(rng, words, max(1, int(size * part)))))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    copies = [f"c{i}" for i in range(80)]
    texts += [" ".join(_edited(rng, copies, rng.randrange(0, 4))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (None, texts[0]), (None, None), (3, texts[3])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs).collect())
    assert got == _near(rows)


def test_near_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs).collect())
    assert got == _near([(r.doc_id, r.text) for r in docs.collect()])


def test_near_odd_rows(none, clash):
    assert jaccard.near_groups(none).count() == 0
    rows = jaccard.near_groups(clash).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_sketch_bounds_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, len(x))) :], rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64)]))
        apart = len(np.setxor1d(x, y))
        a, b = jaccard.parity(x, jaccard.sketch_bits(len(x))), jaccard.parity(y, jaccard.sketch_bits(len(y)))
        size = min(len(a), len(b))
        assert int(np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum()) <= apart
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            assert apart <= jaccard.bound(len(x), len(y))
            assert len(np.intersect1d(jaccard.signatures(x), jaccard.signatures(y)))


def _repeats(texts):
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [50_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    """Passages of lengths around the limit in many surroundings, copies, edited copies, periodic texts."""
    monkeypatch.setattr(substrings, "GROUP", group)
    rng = random.Random(group)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (399, 400, 401, 430, 600, 1500)]
    texts = [noise(rng.randrange(0, 700)) + rng.choice(passages) + noise(rng.randrange(0, 700)) for _ in range(30)]
    long = noise(2500)
    texts += [long, long[:1200] + "X" + long[1200:], long[300:], "ab" * 700, "a" * 399, "a" * 400, "a" * 950, "é" * 300, "", noise(399), passages[1]]
    texts += [passages[0] + "q", "q" + passages[0], texts[0], texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, long), (901, "x"), (901, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((r[0], *x) for r, x in zip(rows, _repeats([(t or "").encode() for _, t in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.cut_repeats(docs).collect())
    assert got == want


def test_repeats_odd_rows(none, clash, odd):
    assert substrings.cut_repeats(none).count() == 0 and substrings.cut_repeats(clash).count() == len(ODD)
    kept = {r.doc_id: bytes(r.kept) for r in substrings.cut_repeats(odd, keep_bytes=True).collect()}
    assert kept[11] == b"" and kept[7] == b"one two"


def test_deep_shallow_sorts():
    rng = random.Random(2)
    texts = [b"p" * 64 + bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 90))) * rng.randrange(1, 3) for _ in range(500)]
    texts += [texts[3]] * 4
    assert [texts[i] for i in substrings.deep_shallow(texts)] == sorted(texts)


def _cosines(rows):
    good = [(i, np.array(v, float)) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links.append((i, j))
    return links


def test_vectors_equal_brute_force(spark):
    """Clusters near the limit, equal vectors, scaled vectors, and vectors that link with nothing."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(60):
        center = rng.standard_normal(24)
        rows += [center + rng.standard_normal(24) * s for s in (0, 0, 0.15, 0.25, 0.3, 0.35)]
    rows += [rows[0] * 3, -rows[0], rng.standard_normal(7)]
    table = [(i, r.tolist()) for i, r in enumerate(rows)]
    table += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [float("inf")] * 24), (None, rows[5].tolist())]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).collect()
    links = _cosines(table)
    want = Counter(x for pair in links for x in pair)
    found, exist = sum(r.n_links for r in got), sum(want.values())
    assert len(got) == len(table) and 0.97 * exist <= found <= exist
    by_id = {r.vec_id: r for r in got}
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in range(900, 906))
    assert all(by_id[i].n_links <= want[i] for i in range(len(rows)))
    assert by_id[1].component_id == by_id[0].component_id == by_id[len(rows) - 3].component_id == 0
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(4)
    grid = vectors.Grid(rng.standard_normal((9, 4)), rng.standard_normal((9, 4)))
    filled = (rng.random(81) < 0.6).astype(int)
    d1, d2 = rng.random(9), rng.random(9)
    all_ = (d1[:, None] + d2[None, :]).ravel()
    want = [c for c in np.argsort(all_) if filled[c]]
    assert grid.nearest_cells(d1, d2, filled, 30) == want[:30] and sorted(grid.nearest_cells(d1, d2, filled, 500)) == sorted(want)


def test_recall_near_the_limit(spark):
    """Many clusters whose cosines lie on both sides of the limit, among vectors without any link."""
    rng = np.random.default_rng(21)
    centers = rng.standard_normal((300, 48))
    rows = np.concatenate([centers + rng.standard_normal(centers.shape) * s for s in (0.22, 0.28, 0.32, 0.35)] + [rng.standard_normal((1500, 48))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    exist = int((unit @ unit.T >= 0.9).sum()) - len(unit)
    found = vectors.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert exist > 1000 and 0.95 * exist <= found <= exist


def test_normalisation_is_ascii_only():
    assert re.sub("[\x20\x09-\x0d]+", " ", "a b c \t d") == "a b c d"


def test_few_texts_are_worked_on_at_a_time(monkeypatch):
    """Executor memory: an Arrow batch of many texts is described and dealt in small slices, which give the same keys."""
    texts = [f"{i} b c d e f {i}" for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), pa.array([t.encode() for t in texts])], names=["doc_id", "text_key", "body"])
    monkeypatch.setattr(jaccard, "ROWS", 30)
    described = list(jaccard._described(iter([batch])))
    assert [b.num_rows for b in described] == [30, 30, 30, 10]
    packed = pa.Table.from_batches(described).select(["keys", "cls"]).combine_chunks().to_batches()
    dealt = list(jaccard._dealt(iter(packed), 4))
    assert len(dealt) == 4
    monkeypatch.setattr(jaccard, "ROWS", 1000)
    pairs = lambda batches: sorted((p, k[i * 6 : i * 6 + 6], c[i * 8 : i * 8 + 8]) for b in batches for p, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True) for i in range(len(k) // 6))
    assert pairs(dealt) == pairs(jaccard._dealt(iter(packed), 4))


def _block_rows(rows):
    names = ["bucket", "i", "j", "mine", "cls", "component", "n_shingles", "sketch", "told"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_blocks_are_compared_across_batches(step):
    """Every pair of different components is met once in its block, wherever Arrow batches end, unless an earlier bucket told it."""
    rng = random.Random(8)
    rows, want = [], Counter()
    for bucket in range(30):
        i, j = rng.choice([(0, 0), (1, 1), (0, 1)])
        mine = [(rng.choice([i, j]), 100 * bucket + k, rng.choice([1, 1, 1, 2, 3, k + 10]), rng.choice([[], [], [-5], [-5, -4], [-4]])) for k in range(rng.randrange(1, 12))]
        rows += [(bucket, i, j, side, cls, comp, 40, b"\0" * 16, told) for side, cls, comp, told in mine]
        for x in range(len(mine)):
            for y in range(x):
                if mine[x][2] != mine[y][2] and (i == j or mine[x][0] != mine[y][0]) and not set(mine[x][3]) & set(mine[y][3]):
                    want[mine[y][1], mine[x][1]] += 1
    batches = [_block_rows(rows[at : at + step]) for at in range(0, len(rows), step)]
    found = Counter(p for b in jaccard._compared(iter(batches), False) for p in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert found == want
    near = {x for b in jaccard._compared(iter(batches), True) for p in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in [p]}
    assert near <= set(want)
