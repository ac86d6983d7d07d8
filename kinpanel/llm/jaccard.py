"""N-gram Jaccard join: parity sketches, pigeonhole join by size band, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import partitions, spread_join, stored
from kinpanel.llm.graph import components

#: Five words a shingle; texts link when 100 * |common| >= 75 * |all|.
WORDS, PERCENT = 5, 75
#: Tokens a parity block holds on average in the largest sets of a band; below ``FINE`` tokens a block has one token.
PER_BLOCK, FINE = 2.4, 128
#: Keys meet in tasks that own the keys of about so many shingles (at most 14 bytes a key, about 0.6 keys a shingle).
SHARE = 2_000_000
#: Texts of an Arrow batch that are worked on at a time.
ROWS = 2000
#: Texts of a bucket that are compared at a time.
CHUNK = 2048
#: Larger buckets are first joined through nearest partners.
FEW = 32
#: So many open buckets of a text, the least ones, travel with it: a pair that meets in one of them is told there only.
TOLD = 16
#: Passes through nearest partners go on while one pair in so many that they try is a link.
WORTH = 8
#: Texts whose ids are few enough (16 bytes each) are picked out of the corpus by broadcast; else by a join.
PICKED = 2_000_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shingler:
    """Distinct hashed shingles of a text, sorted. Words are remembered as rows of a table, up to a bound."""

    def __init__(self, size: int = WORDS, most: int = 200_000):
        self.size, self.most = size, most
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros(1024, np.uint64)

    def _new(self, word: bytes) -> int:
        row = len(self.rows)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = xxhash.xxh3_64_intdigest(word)
        self.rows[word] = row
        return row

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.rows) > self.most:
            self.rows = {}
        get = self.rows.get
        at = [r if (r := get(w)) is not None else self._new(w) for w in text.lower().split()]
        h = self.table[np.array(at, np.int64)] if at else np.empty(0, np.uint64)
        if len(h) == 0:
            return h
        size = self.size if len(h) >= self.size else len(h)
        s = np.full(len(h) - size + 1, np.uint64(size + 1))
        for i in range(size):
            s = (s ^ (s >> np.uint64(31))) * _C[i % 5] + h[i : i + len(s)]
        return np.unique(mixed(s))


def mixed(s: np.ndarray) -> np.ndarray:
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets, and (but for chance of 2^-64 a pair) no others, share it."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def edges_of_bands() -> list[int]:
    """First sizes of bands: each starts above 16/9 of the one before, so a text meets partners in two bands at most."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 16 // 9 + 1)
    return out


_EDGES = np.array(edges_of_bands())


def bound(a: int, b: int) -> int:
    """Most tokens by which two sets of these sizes may differ when they link."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def sketch_bits(n: int) -> int:
    return max(64, 1 << int(2 * n - 1).bit_length())


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit i is the parity of the number of tokens that fall on i: sets that differ in d tokens differ in d bits at most."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch with fewer bits: the halves XORed."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def signatures(s: np.ndarray) -> np.ndarray:
    """Keys of one set. In each band where it can meet a partner (its own, and the next if 4/3 of its size reaches it) the tokens
    fall into blocks by hash; a block's value is the XOR of its tokens. Sets that differ in d tokens differ in d blocks at
    most, so of the first d+1 blocks that hold tokens, in a fixed order, one is the same on both sides: those are keys."""
    n = len(s)
    own = int(np.searchsorted(_EDGES, n, "right")) - 1
    bands = [own] + [own + 1] * (n * 100 >= int(_EDGES[own + 1]) * PERCENT)
    spread = mixed(s)
    order = np.argsort(spread)  # by block, whatever the number of blocks: blocks are ranges of the second hash
    spread, tokens = spread[order], s[order]
    out = []
    for band in bands:
        most = int(_EDGES[band + 1]) - 1
        keep = bound(n, min(n * 100 // PERCENT, most)) + 1
        if most < FINE:
            values = tokens[:keep]
        else:
            blocks = np.uint64(max(int(most / PER_BLOCK), 1))
            block = ((spread >> np.uint64(32)) * blocks) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            values = (np.bitwise_xor.reduceat(tokens, first) + block[first] * _C[1])[:keep]
        out.append(mixed(values ^ np.uint64((band + 1) * int(_C[2]) % (1 << 64))))
    return np.concatenate(out)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, class, sketch and keys of every text; the first 48 bits of a key are kept."""
    shingler = Shingler()
    for batch in _sliced(batches):
        n, cls, sketches, keys = [], [], [], []
        for t in batch.column(2):
            s = shingler(t.as_py() or b"")
            n.append(len(s))
            cls.append(class_of(s))
            sketches.append(parity(s, sketch_bits(len(s))).tobytes() if len(s) else b"")
            keys.append((signatures(s) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if len(s) else b"")
        made = [pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_key", "n_shingles", "cls", "sketch", "keys"])


def _numbers(packed: list[bytes]) -> np.ndarray:
    """Keys of six bytes each as numbers."""
    low = np.zeros((sum(map(len, packed)) // 6, 8), np.uint8)
    low[:, :6] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
    return low.view(np.uint64)[:, 0]


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed (key, class) pairs by destination, which the first bits of the key choose: six bytes of key and eight of class."""
    for batch in _sliced(batches):
        packed = batch.column(0).to_pylist()
        key, cls = _numbers(packed), np.repeat(batch.column(1).to_numpy(), [len(k) // 6 for k in packed])
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]) if len(key) else np.zeros(0, bool)
        key, cls = key[new], cls[new]
        part = ((key >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        low = key.view(np.uint8).reshape(-1, 8)[:, :6]
        ends = np.searchsorted(part, np.arange(parts + 1))
        some = [p for p in range(parts) if ends[p] < ends[p + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([low[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary()), pa.array([cls[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary())],
            names=["part", "keys", "classes"],
        )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that share a key: (bucket, its first class, class). Buckets with the same members are told once a task."""
    keys: dict[int, list] = {}
    for batch in batches:
        for part, k, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            keys.setdefault(part, []).append((k, c))
    for part in list(keys):
        blobs = keys.pop(part)
        key, cls = _numbers([k for k, _ in blobs]), np.frombuffer(b"".join(c for _, c in blobs), np.int64)
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls = key[new], cls[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            continue
        told = np.repeat(size, size)
        rows = np.repeat(start, size) + (np.arange(len(told)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size))
        members, at = cls[rows], np.concatenate([[0], np.cumsum(size)[:-1]])
        name = np.bitwise_xor.reduceat(mixed(members.view(np.uint64)), at) + size.astype(np.uint64) * _C[3]
        _, one = np.unique(name, return_index=True)
        chosen = np.zeros(len(start), bool)
        chosen[one] = True
        mask = np.repeat(chosen, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[mask].view(np.int64)), pa.array(np.repeat(members[at], size)[mask]), pa.array(members[mask])], names=["bucket", "first", "cls"])


def _likely(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link. ``info``: cls, n_shingles, sketch."""
    for side in ("a", "b"):
        seen = pairs.groupBy(side).agg(F.count("*").alias("times"))
        mine = stored(info.select(F.col("cls").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")).join(seen, side))
        pairs = spread_join(pairs, mine, side, "times", pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            ok = [may_link(*x) for x in zip(na, nb, sa, sb, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def may_link(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    if min(na, nb) * 100 < max(na, nb) * PERCENT:
        return False
    size = min(len(sa), len(sb))
    x, y = folded(np.frombuffer(sa, np.uint8), size), folded(np.frombuffer(sb, np.uint8), size)
    return int(np.bitwise_count(x ^ y).sum()) <= bound(na, nb)


def _linked(pairs: DataFrame, documents: DataFrame, body, info: DataFrame) -> DataFrame:
    """Pairs that link, by their whole sets, which are read for the classes of these pairs alone."""
    asked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _sets(documents, body, stored(asked.join(info, "cls").select("cls", "text_key")))
    for side in ("a", "b"):
        seen = pairs.groupBy(side).agg(F.count("*").alias("times"))
        mine = stored(sets.select(F.col("cls").alias(side), F.col("tokens").alias(f"t{side}")).join(seen, side))
        pairs = spread_join(pairs, mine, side, "times", pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(ta.as_py(), np.uint64), np.frombuffer(tb.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return stored(pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _across(members: DataFrame, info: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of different components in one bucket whose sizes and sketches allow a link; compared in blocks, not listed.

    ``members``: bucket, cls, component. Large buckets are dealt over tasks as pairs of chunks. ``nearest``: of a text's
    possible partners in a block only the one with the nearest sketch. A pair that meets in many buckets is told in the least
    of them, as far as the ``TOLD`` least buckets of both texts show it; a pair is never left out in its least bucket.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    told = members.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("bucket")), 1, TOLD).alias("told"))
    rows = members.join(sizes, "bucket").join(info.select("cls", "n_shingles", "sketch").join(told, "cls"), "cls")
    mine = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Only buckets before this one tell that a pair was told before.
    before = F.filter("told", lambda b: b < F.col("bucket")).alias("told")
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "component", "n_shingles", "sketch", before)
    place = ["bucket", "i", "j"]
    dealt = rows.repartition(partitions(members.sparkSession), *place).sortWithinPartitions(*place)
    found = dealt.mapInArrow(lambda batches: _compared(batches, nearest), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compared(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows come block by block, a block of ``2 * CHUNK`` rows or so at a time."""

    def pairs(columns: list, at: int, end: int) -> list[tuple[int, int]]:
        i, j = int(columns[1][at]), int(columns[2][at])
        mine, cls, comp, n = (c[at:end] for c in columns[3:7])
        kinds, kind, times = np.unique(comp, return_inverse=True, return_counts=True)
        if len(kinds) == 1:
            return []
        # Every pair has a text outside the component with most texts: only those look for partners.
        main = kind == times.argmax()
        texts, (begins, told) = columns[7][at:end], columns[8]
        size = min(map(len, texts))
        bits = np.stack([folded(np.frombuffer(t, np.uint8), size) for t in texts]).view(np.uint64)
        sides = [np.flatnonzero(mine == k) for k in (i, j)]
        out = set()
        for x in np.flatnonzero(~main).tolist():
            first = i == j or mine[x] == i
            some = sides[1] if first else sides[0]
            apart_from = comp[some] != comp[x]
            if not nearest:  # each pair once
                apart_from &= main[some] | (some > x if i == j else first)
            some = some[apart_from]
            some = some[np.minimum(n[some], n[x]) * 100 >= np.maximum(n[some], n[x]) * PERCENT]
            apart = np.bitwise_count(bits[some] ^ bits[x]).sum(axis=1, dtype=np.int64)
            close = apart <= (n[some] + n[x]) * (100 - PERCENT) // (100 + PERCENT)
            if close.any():
                near = some[close] if not nearest else some[[apart.argmin()]]
                out |= {(min(x, y), max(x, y)) for y in near.tolist()}
        before = {x: frozenset(told[begins[at + x] : begins[at + x + 1]].tolist()) for pair in out for x in pair}
        return [(int(cls[x]), int(cls[y])) for x, y in out if before[x].isdisjoint(before[y])]

    def blocks(table: pa.RecordBatch, last: bool) -> tuple[list[tuple[int, int]], int]:
        """Pairs of the whole blocks of a table, and where the block starts that may go on."""
        lists = table.column(8)
        columns = [*(table.column(k).to_numpy() for k in range(7)), table.column(7).to_pylist(), (lists.offsets.to_numpy(), lists.values.to_numpy())]
        new = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1]).tolist()
        ends = [*starts[1:], *([table.num_rows] if last else [])]
        return [p for at, end in zip(starts, ends, strict=False) if end - at > 1 for p in pairs(columns, at, end)], starts[-1]

    rest = None
    for batch in batches:
        if batch.num_rows:
            whole = pa.concat_batches([rest, batch]) if rest is not None else batch
            found, at = blocks(whole, False)
            rest = whole.slice(at)
            yield _pairs(found)
    if rest is not None:
        yield _pairs(blocks(pa.concat_batches([rest]), True)[0])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``, the smallest id reachable by links; with ``by_text`` also
    ``text_key`` (see ``text_hash``) and ``component``, which tells components apart where ids repeat. A text without shingles has
    its ``text_key`` for a component.

    Texts with one set of shingles are a class and link among themselves. Classes that share a key of their parity
    sketches meet in a bucket. First every class is compared with the first of its buckets, which joins large groups of
    copies with few comparisons. Then classes of a bucket that are still in different components are compared in blocks:
    with the nearest of them as long as that finds many links, at last with all, so no link is lost. Sketches only rule
    pairs out; a link counts after both whole sets were compared.

    A null or empty text has no shingles and is alone. With fewer than five words the whole sequence is the one shingle.
    Rows without id take part; their component is the smallest id reached, null if there is none. Rows that repeat an id
    give a row each. Other columns are not read. Sets are compared by 64-bit hashes of shingles.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    described = stored(
        documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("body")).mapInArrow(
            _described, f"doc_id {kind}, text_key long, n_shingles long, cls long, sketch binary, keys binary"
        )
    )
    filled = described.filter("n_shingles > 0")
    info = stored(filled.groupBy("cls").agg(F.min("n_shingles").alias("n_shingles"), F.min("text_key").alias("text_key"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least_id")))
    shingles = filled.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(2 * partitions(spark), shingles // SHARE)
    packed = filled.select("keys", "cls").mapInArrow(lambda batches: _dealt(batches, parts), "part int, keys binary, classes binary")
    met = stored(packed.repartitionById(parts, "part").mapInArrow(_met, "bucket long, first long, cls long"))
    stars = met.filter("first <> cls").select(F.least("first", "cls").alias("a"), F.greatest("first", "cls").alias("b")).distinct()
    links = _linked(stored(_likely(stored(stars), info)), documents, body, info)
    whole = stored(components(links))
    # One bucket name stands for one set of members, which several tasks may have told. In a bucket of two classes all is said.
    members = met.select("bucket", "cls").distinct()
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 2")
    members = stored(members.join(several, "bucket"))
    nearest = True
    while True:
        # Small buckets wait for the last pass, which compares all pairs that are left.
        some = members.filter(F.col("n") > FEW) if nearest else members
        placed = some.join(whole.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        open_ = placed.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("open")).filter("open").select("bucket")
        apart = stored(placed.join(open_, "bucket").select("bucket", "cls", "component"))
        tried = found = 0
        if apart.limit(1).count():
            pairs = stored(_across(apart, info, nearest))
            more = _linked(pairs, documents, body, info)
            tried, found = pairs.count(), more.count()
        if found:
            links = stored(links.unionByName(more))
            whole = stored(components(links))
        if not nearest:
            break
        nearest = found * WORTH > tried
    named = info.join(whole.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).select("cls", "component", "least_id")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = stored(named.join(least, "component").join(filled.groupBy("cls").agg(F.count("*").alias("rows")), "cls").select("cls", "component_id", "rows", *(["component"] if by_text else [])))
    # A class may hold any part of the rows.
    keys = ["text_key"] if by_text else []
    alone = described.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *keys, *(F.col(k).alias("component") for k in keys))
    joined = spread_join(filled.select("doc_id", "n_shingles", "cls", *keys), per_class, "cls", "rows", filled.count())
    return joined.select(*alone.columns).unionByName(alone)


def _sets(documents: DataFrame, body, wanted: DataFrame) -> DataFrame:
    """Whole sets of the wanted classes, one row each, from one more reading of the texts."""
    texts = documents.select(body.alias("body")).withColumn("text_key", F.xxhash64("body"))
    keys = wanted.select("text_key").distinct()
    if wanted.count() <= PICKED:
        keys = F.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in _sliced(batches):
            found = [shingler(t) for t in dict.fromkeys(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["cls", "tokens"])

    found = texts.join(keys, "text_key", "left_semi").select("text_key", "body").mapInArrow(run, "cls long, tokens binary")
    return stored(found.groupBy("cls").agg(F.first("tokens").alias("tokens")))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
