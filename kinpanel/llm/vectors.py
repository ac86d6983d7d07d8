"""Embedding near-duplicates: inverted multi-index, multi-sequence traversal, verified cosines."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import lookup, partitions, stored
from kinpanel.llm.graph import components

COSINE = 0.9
#: Bounds of the fit: rows of the sample for the codebooks, words of a codebook, sample rows whose partners set the depth.
SAMPLE, MOST_WORDS, PROBES = 20_000, 1024, 1500
#: Share of linked pairs that the traversal must meet from one side or the other, on pairs of the sample and on made pairs
#: whose cosine lies anywhere between the limit and 1.
RECALL = 0.995
#: Vectors of a cell that a task holds at a time.
BLOCK = 1024


def codebook(half: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Means of Lloyd's rounds from evenly spaced rows."""
    centers = half[np.linspace(0, len(half) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(half, centers)
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=words)
        np.add.at(sums, near, half)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return centers


def distances(half: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (half**2).sum(axis=1)[:, None] - 2 * half @ centers.T + (centers**2).sum(axis=1)


def nearest(half: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(half[i : i + 4096], centers).argmin(axis=1) for i in range(0, len(half), 4096)] or [np.empty(0, int)])


class Grid:
    """The product of two codebooks; a cell is numbered first word times words plus second word."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.words, self.cut = len(first), first.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return nearest(unit[:, : self.cut], self.first) * self.words + nearest(unit[:, self.cut :], self.second)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(unit[:, : self.cut], self.first), distances(unit[:, self.cut :], self.second)

    def nearest_cells(self, d1: np.ndarray, d2: np.ndarray, blocks: np.ndarray, depth: int) -> list[int]:
        """The ``depth`` nearest cells that hold vectors, by the multi-sequence walk: pairs of ranks leave a heap in order of the
        sum of distances; a pair enters it once both pairs before it have left."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        c1, c2 = (o1 * self.words).tolist(), o2.tolist()
        words, heap, out = self.words, [(s1[0] + s2[0], 0, 0)], []
        reached = [0] * (words + 1)  # of each first rank, second ranks that have left
        while heap and len(out) < depth:
            _, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            cell = c1[i] + c2[j]
            if blocks[cell]:
                out.append(cell)
            if i + 1 < words and reached[i + 1] == j:
                heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
            if j + 1 < words and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        return out


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def depth_for(grid: Grid, unit: np.ndarray, filled: np.ndarray, recall: float = RECALL) -> int:
    """Cells to visit so that ``recall`` of linked pairs meet. Pairs: linked pairs inside the sample, and each probe with itself
    turned by a random angle within the limit. The larger of the two depths counts."""
    rng = np.random.default_rng(7)
    probes = unit[np.linspace(0, len(unit) - 1, min(PROBES, len(unit))).astype(int)]
    turned = rng.standard_normal(probes.shape)
    turned -= (turned * probes).sum(axis=1, keepdims=True) * probes
    turned /= np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-300)
    cos = rng.uniform(COSINE, 1, (len(probes), 1))
    made = cos * probes + np.sqrt(1 - cos**2) * turned

    def ranks(x, y):
        d1, d2 = grid.halves(x)
        out = []
        for a, b, cell in zip(d1, d2, grid.cells(y), strict=True):
            all_ = (a[:, None] + b[None, :]).ravel()
            out.append(int((filled & (all_ < all_[cell])).sum()) + 1)
        return np.array(out)

    def needed(x, y):
        if not len(x):
            return 1
        return int(np.quantile(np.minimum(ranks(x, y), ranks(y, x)), recall, method="higher"))

    real = []
    for i in range(0, len(probes), 256):
        p, q = np.nonzero(probes[i : i + 256] @ unit.T >= COSINE)
        real += [(i + a, b) for a, b in zip(p, q, strict=True) if not np.array_equal(probes[i + a], unit[b])]
    real = real[:: max(len(real) // 3000, 1)]
    return max(needed(probes, made), needed(probes[[a for a, _ in real]], unit[[b for _, b in real]]) if real else 1)


def fit(classes: DataFrame, total: int) -> tuple[Grid, np.ndarray]:
    """(grid, sample): codebooks from at most about ``SAMPLE`` rows, taken by hash."""
    rate = min(1.0, SAMPLE / max(total, 1))
    taken = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < int(rate * 1_000_000)).select("vector").limit(2 * SAMPLE)
    rows = [bytes(r[0]) for r in taken.toLocalIterator()] or [bytes(r[0]) for r in classes.select("vector").limit(1).collect()]
    unit = _unit(rows)
    words = int(np.clip(np.sqrt(total / 16), 2, MOST_WORDS))
    cut = max(unit.shape[1] // 2, 1)
    two = unit[:, cut:] if unit.shape[1] > 1 else np.zeros((len(unit), 1))
    words = min(words, len(unit))
    return Grid(codebook(unit[:, :cut], words), codebook(two, words)), unit


def _links(classes: DataFrame, total: int, recall: float) -> DataFrame:
    """Rows (a, null, links of a) and (a, b, 0), a forest over linked classes; for vectors of one length."""
    spark = classes.sparkSession
    grid, sample = fit(classes, total)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = grid.cells(_unit(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=["cls", "n", "vector", "cell"])

    at = stored(classes.select("cls", "n", "vector").mapInArrow(placed, "cls long, n long, vector binary, cell long"))
    sizes = dict(at.groupBy("cell").count().collect())  # cells, at most MOST_WORDS squared
    blocks = np.zeros(grid.words**2, np.int64)
    for cell, n in sizes.items():
        blocks[cell] = -(-n // BLOCK)
    depth = depth_for(grid, sample, blocks > 0, recall)
    kind = "cell long, block long, role int, cls long, n long, home long, seen binary, vector binary"

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector as a member of its cell (role 0) and as a visitor of all blocks of its nearest cells (role 1)."""
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                blobs = batch.column(2).to_pylist()
                d1, d2 = grid.halves(_unit(blobs))
                rows = []
                for i, (cls, n, home) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                    seen = grid.nearest_cells(d1[i], d2[i], blocks, depth)
                    rows.append((home, cls % int(blocks[home]), 0, cls, n, home, np.array(sorted(seen), np.int32).tobytes(), blobs[i]))
                    rows += [(c, b, 1, cls, n, home, b"", blobs[i]) for c in seen for b in range(int(blocks[c]))]
                c = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=kind.replace(" long", "").replace(" int", "").replace(" binary", "").split(", "))

    rows = at.mapInArrow(sent, kind).repartition(2 * partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "role")
    return rows.mapInArrow(_compared, "a long, b long, links long")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block come first and are held; visitors pass by in batches."""
    at, members, unit, tied = None, [], None, {}

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "links"])

    for batch in batches:
        cells, blocks, roles = (batch.column(i).to_numpy() for i in (0, 1, 2))
        starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (roles[1:] != roles[:-1])]))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part = batch.slice(start, end - start)
            if at != (cells[start], blocks[start]):
                at, members, unit, tied = (cells[start], blocks[start]), [], None, {}
            if roles[start] == 0:
                members += [(c, n, np.frombuffer(s, np.int32), v) for c, n, s, v in zip(*(part.column(i).to_pylist() for i in (3, 4, 6, 7)), strict=True)]
                unit = None
                continue
            if not members:
                continue
            if unit is None:
                unit = _unit([m[3] for m in members])
                names, counts = np.array([m[0] for m in members]), np.array([m[1] for m in members])
            for i in range(0, part.num_rows, 256):
                rows, got = [], Counter()
                some = part.slice(i, 256)
                who, n, cell = (some.column(k).to_numpy() for k in (3, 4, 5))
                close = _unit(some.column(7).to_pylist()) @ unit.T >= COSINE
                for x in np.flatnonzero(close.any(axis=1)):
                    # A pair that meets from both sides counts where the smaller one visits.
                    linked = [y for y in np.flatnonzero(close[x]).tolist() if names[y] != who[x] and (who[x] < names[y] or not _visits(members[y][2], cell[x]))]
                    if not linked:
                        continue
                    rows += [(int(who[x]), None, int(counts[linked].sum())), (int(who[x]), int(names[linked[0]]), 0)]
                    got.update({y: int(n[x]) for y in linked})
                    root = _root(tied, linked[0])
                    for y in linked[1:]:
                        other = _root(tied, y)
                        if other != root:
                            tied[other] = root
                            rows.append((int(names[root]), int(names[y]), 0))
                rows += [(int(names[y]), None, links) for y, links in got.items()]
                if rows:
                    yield out(rows)


def _visits(seen: np.ndarray, cell: int) -> bool:
    i = int(np.searchsorted(seen, cell))
    return i < len(seen) and seen[i] == cell


def _root(tied: dict[int, int], y: int) -> int:
    while y in tied:
        y = tied[y]
    return y


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors link when their cosine, in double precision, is at least ``COSINE`` and they have the same length. Null, empty
    and zero vectors, and those with null or non-finite components, link with nothing. Equal vectors are one class,
    counted by its rows; they link among themselves. The index holds every class; each class visits its nearest cells
    and every pair that meets is verified, so no false link is counted; pairs that do not meet are missed, ``1 - recall`` of
    them by the calibration. Rows without id count as rows; their component is the smallest id reached, or null. Repeated
    ids give a row each. Other columns are not read. An empty table gives an empty table.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fine = F.coalesce(F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))
    keys = [F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(7), x).alias("k2")]
    rows = stored(vectors.select(F.col(id_col).alias("vec_id"), fine.alias("fine"), *keys))
    packed = vectors.filter(fine).select(F.col(id_col).alias("vec_id"), x.alias("x"), *keys).mapInArrow(_packed, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, k1 long, k2 long, size int, vector binary")
    grouped = packed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("size").alias("size"), F.first("vector").alias("vector"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()))
    lengths = {r[0]: r[1] for r in classes.groupBy("size").count().orderBy(F.desc("count")).limit(64).collect()}
    if len(lengths) == 64:
        raise ValueError("vectors of more than 63 lengths")
    found = [_links(classes.filter(F.col("size") == size), total, recall) for size, total in lengths.items()]
    empty = classes.sparkSession.createDataFrame([], "a long, b long, links long")
    found = stored(reduce(DataFrame.unionByName, found, empty))
    degree = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    joined = stored(components(found.filter("b is not null").select("a", "b")))
    named = classes.select("cls", "k1", "k2", "n", "least_id").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long")
    per_class = stored(named.join(least, "component").join(degree, "cls", "left").select("k1", "k2", "n", "component_id", links.alias("n_links")))
    good = rows.filter("fine").drop("fine")
    out = lookup(good, per_class, ["k1", "k2"], "n", good.count()).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(1)
        size = np.diff(x.offsets.to_numpy())
        flat = np.ascontiguousarray(x.values.to_numpy(zero_copy_only=False), np.float64)
        offsets = x.offsets.to_numpy()
        blobs = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(size, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "k1", "k2", "size", "vector"])


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
