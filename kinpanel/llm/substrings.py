"""Removal of repeated substrings: suffixes at sampled places, ordered by deep-shallow sorting."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import lookup, partitions, stored

#: Bytes of a string that counts as repeated, and of the grams by which strings are anchored (a power of two).
LENGTH, GRAM = 400, 64
#: Bytes that are anchored at a time, and the depth down to which multikey quicksort goes.
PIECE, SHALLOW = 1 << 20, GRAM + 32
#: Texts of an Arrow batch that are worked on at a time.
ROWS = 500
#: Groups of more places than this are solved by counts of windows over the cluster in place of one sorted group.
GROUP = 50_000
#: Texts whose ids are few enough (16 bytes each) are picked out of the corpus by broadcast; else by a join.
PICKED = 2_000_000
_REACH = LENGTH - GRAM + 1
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_ODD = np.array([xxhash.xxh3_64_intdigest(bytes([b, 1])) | 1 for b in range(16)], np.uint64)
_POS = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    h, width, step = _BYTE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _ODD[step] + h[width:]
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window of ``LENGTH`` bytes from each place on, gram hashes). The anchor is the first gram of the window
    with the least hash: equal windows have it at the same offset, wherever they stand."""
    h = gram_hashes(data)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _REACH:
        low = np.minimum(low[: -(_REACH - width)], low[_REACH - width :])
    return (low & _POS).astype(np.int64), h


def places(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, gram hash, hash of the bytes, anchor, first and last start) for each run of window starts with one anchor.
    Texts are taken together up to ``PIECE`` bytes; longer ones in pieces that overlap by a window."""
    todo = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t) - LENGTH + 1, PIECE)]
    while todo:
        some, size = [], 0
        while todo and (not some or size < PIECE):
            i, at = todo.pop()
            part = texts[i][at : at + PIECE + LENGTH - 1]
            some.append((i, at, size, part))
            size += len(part)
        data = np.frombuffer(b"".join(p for *_, p in some), np.uint8)
        anchor, h = anchors(data)
        for i, at, offset, part in some:
            mine = anchor[offset : offset + len(part) - LENGTH + 1]
            first = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
            last = np.concatenate([first[1:] - 1, [len(mine) - 1]])
            for a, lo, hi in zip(mine[first].tolist(), first.tolist(), last.tolist(), strict=True):
                yield i, int(h[a]), xxhash.xxh3_64_intdigest(part[lo : hi + LENGTH], a - offset - lo), at + a - offset, at + lo, at + hi


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, gram, bytes, anchor, first, last, times). What repeats inside a text is told once, with two times, and
    its other places as covered spans (times 0): a text of one repeated byte gives few rows."""
    for batch in _sliced(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        seen: dict[tuple[int, int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for i, gram, body, a, lo, hi in places(texts):
            seen[i, gram, body].append((a, lo, hi))
        covered = defaultdict(list)
        rows = []
        for (i, gram, body), found in seen.items():
            rows.append((ids[i], gram, body, *min(found), min(len(found), 2)))
            if len(found) > 1:
                covered[i] += [(lo, hi + 1) for _, lo, hi in found]
        rows += [(ids[i], 0, 0, -1, lo, hi - 1, 0) for i, spans in covered.items() for lo, hi in merged(spans)]
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.binary()), _signed(c[1]), _signed(c[2]), *(pa.array(x, pa.int64()) for x in c[3:])], names=["text_id", "gram", "body", "anchor", "first", "last", "times"]
            )


def common(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    end = min(len(x), len(y))
    if x[start:end] == y[start:end]:
        return end
    lo, hi = start, end
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Strings by the places and bytes where they part. A new string follows the branches blindly to some leaf; one comparison
    with that leaf gives its true place. The end of a string is byte -1."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None

    @staticmethod
    def _byte(text: bytes, at: int) -> int:
        return text[at] if at < len(text) else -1

    def insert(self, i: int, depth: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        text, node = self.texts[i], self.root
        while isinstance(node, tuple):
            branches = node[1]
            node = branches.get(self._byte(text, node[0])) or next(iter(branches.values()))
        near = self.texts[node[0]]
        same = common(text, near, depth)
        if same == len(text) == len(near):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][self._byte(text, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][self._byte(text, same)] = [i]
            return
        split = (same, {self._byte(near, same): node, self._byte(text, same): [i]})
        if parent is None:
            self.root = split
        else:
            parent[1][self._byte(text, parent[0])] = split

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(texts: list[bytes], depth: int = GRAM, shallow: int = SHALLOW) -> list[int]:
    """Order of the texts, which agree in their first ``depth`` bytes: multikey quicksort down to ``shallow``, blind tries below."""
    out: list[int] = []
    todo = [(list(range(len(texts))), depth)]
    while todo:
        rows, at = todo.pop()
        if len(rows) < 2:
            out += rows
        elif at >= shallow:
            trie = BlindTrie(texts)
            for i in rows:
                trie.insert(i, at)
            out += trie.order()
        else:
            byte = [texts[i][at] if at < len(texts[i]) else -1 for i in rows]
            pivot = sorted(byte[:: max(len(byte) // 9, 1)])[min(len(byte), 9) // 2] if len(byte) > 2 else byte[0]
            less = [i for i, b in zip(rows, byte, strict=True) if b < pivot]
            same = [i for i, b in zip(rows, byte, strict=True) if b == pivot]
            more = [i for i, b in zip(rows, byte, strict=True) if b > pivot]
            # Texts that ended here are equal.
            todo += [(more, at), (same, at + 1) if pivot >= 0 else (same, shallow), (less, at)]
    return out


def group_cover(members: list[tuple[bytes, int]]) -> list[list[tuple[int, int]]]:
    """For each place of one gram, given as (bytes of its windows, offset of the gram in them): the ranges of t, the number of
    bytes before the gram, for which the window is also a window of another place.

    The right sides are sorted; every interval of the order with one longest common prefix R is a group in which
    windows with t >= 400 - R agree on the right. In it the left sides, in the order of their reversed bytes, agree most
    with a neighbour; that length bounds t from above."""
    right = [c[off:] for c, off in members]
    left = [c[:off][::-1] for c, off in members]
    order = deep_shallow(right)
    k = len(order)
    prefix = [common(right[order[i - 1]], right[order[i]]) if i else 0 for i in range(k)]
    rank = {i: r for r, i in enumerate(sorted(range(k), key=left.__getitem__))}
    out: list[list[tuple[int, int]]] = [[] for _ in members]

    def settle(rows: list[int], same: int) -> None:
        rows = sorted(rows, key=rank.__getitem__)
        beside = [common(left[rows[i - 1]], left[rows[i]]) if i else -1 for i in range(len(rows))] + [-1]
        for j, i in enumerate(rows):
            low = max(LENGTH - same, LENGTH - len(right[i]))
            high = min(members[i][1], max(beside[j], beside[j + 1]))
            if low <= high:
                out[i].append((low, high))

    stack: list[tuple[int, int]] = []  # (prefix, first place in the order) of open intervals
    for i in range(1, k + 1):
        now, start = (prefix[i] if i < k else -1), i - 1
        while stack and stack[-1][0] > now:
            same, start = stack.pop()
            settle(order[start:i], same)
        if i < k and (not stack or stack[-1][0] < now):
            stack.append((now, start))
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        rows = []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            text = text.as_py()
            rows += [(w["gram"], w["body"], w["anchor"] - w["first"], text[w["first"] : w["last"] + LENGTH]) for w in wanted]
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.binary())], names=["gram", "body", "offset", "context"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram -> (gram, body, start, end): covered bytes, counted from the first window on."""

    def solved(gram, group):
        found = group_cover([(c, off) for _, off, c in group])
        return [(gram, body, off - high, off - low + LENGTH) for (body, off, _), ranges in zip(group, found, strict=True) for low, high in ranges]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["gram", "body", "start", "end"])

    at, group, rows = None, [], []
    for batch in batches:
        for gram, body, off, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if gram != at:
                if len(group) > 1:
                    rows += solved(at, group)
                at, group = gram, []
            group.append((body, off, context))
        if rows:
            yield table(rows)
            rows = []
    if len(group) > 1:
        yield table(solved(at, group))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for gram, body, off, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(gram, body, s, off - s, xxhash.xxh3_64_intdigest(context[s : s + LENGTH]) - (1 << 63)) for s in range(len(context) - LENGTH + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["gram", "body", "start", "t", "window"])


def _counted_windows(contexts: DataFrame) -> DataFrame:
    """The same cover for groups too large to sort in one task: windows are counted by hash, before and after the shuffle."""
    windows = stored(contexts.mapInArrow(_windows, "gram long, body long, start long, t long, window long"))
    counts = stored(windows.groupBy("gram", "t", "window").agg(F.count("*").alias("n")).filter("n > 1"))
    found = lookup(windows, counts, ["gram", "t", "window"], "n", windows.count())
    return found.select("gram", "body", "start", (F.col("start") + LENGTH).alias("end"))


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Each wanted text once."""
    ids = F.broadcast(ids) if ids.count() <= PICKED else ids
    return texts.join(ids, "text_id", "left_semi").groupBy("text_id").agg(F.first("text").alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        removed, n, digest = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            whole = merged((s["start"], s["end"]) for s in spans)
            kept, at = [], 0
            for a, b in whole:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            removed.append(sum(b - a for a, b in whole))
            n.append(len(whole))
            digest.append(b"".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in digest]), pa.array(digest, pa.binary())],
            names=["text_id", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_spans(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: ``text_id, text`` of every row, lazily; spans: ``text_id`` and the array of covered spans, a written table).

    Every window of ``LENGTH`` bytes is anchored at one gram. Places with one gram whose windows are the same bytes are a class;
    classes are counted, so hot copies cost a row per task. Where a gram has several classes, one context of each is read
    and sorted with the others."""
    spark = documents.sparkSession
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = documents.select(F.unhex(F.md5(body)).alias("text_id"), body.alias("text"))
    kind = "text_id binary, gram long, body long, anchor long, first long, last long, times long"
    placed = stored(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(_placed, kind))
    own = placed.filter("times > 0")
    classes = stored(own.groupBy("gram", "body").agg(F.sum("times").alias("times"), F.count("*").alias("rows"), F.min(F.struct("text_id", "anchor", "first", "last")).alias("at")))
    several = classes.groupBy("gram").agg(F.count("*").alias("classes")).filter("classes > 1")
    wanted = stored(classes.join(several, "gram").select("gram", "body", "at", "classes"))
    asked = stored(wanted.groupBy("at.text_id").agg(F.collect_list(F.struct("gram", "body", "at.anchor", "at.first", "at.last")).alias("wanted")))
    read = _picked(texts, asked.select("text_id")).join(asked, "text_id").select("text", "wanted")
    contexts = read.mapInArrow(_contexts, "gram long, body long, offset long, context binary")
    large = stored(several.filter(F.col("classes") > GROUP).select("gram"))  # at most rows / GROUP
    if large.limit(1).count():
        contexts = stored(contexts)
        counted = _counted_windows(contexts.join(large, "gram", "left_semi"))
        contexts = contexts.join(large, "gram", "left_anti")
    else:
        counted = None
    found = contexts.repartition(partitions(spark), "gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups, "gram long, body long, start long, end long")
    found = found if counted is None else found.unionByName(counted)
    # A class of two places or more is covered as a whole; others where sorting found a partner.
    whole = classes.filter("times > 1").select("gram", "body", F.lit(0).cast("long").alias("start"), (F.col("at.last") - F.col("at.first") + LENGTH).alias("end"))
    spans = found.unionByName(whole).groupBy("gram", "body").agg(F.collect_set(F.struct("start", "end")).alias("parts"))
    spans = stored(spans.join(classes.select("gram", "body", "rows"), ["gram", "body"]))
    met = lookup(own.select("text_id", "gram", "body", "first"), spans, ["gram", "body"], "rows", own.count())
    part = F.col("part")
    met = met.select("text_id", "first", F.explode("parts").alias("part")).select("text_id", (F.col("first") + part.start).alias("start"), (F.col("first") + part.end).alias("end"))
    inside = placed.filter("times = 0").select("text_id", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    return texts, stored(met.unionByName(inside).groupBy("text_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def cut_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left, if asked).

    A byte goes when a string of ``LENGTH`` bytes that covers it also starts at another place of the corpus, in the same
    text or another row (repeated rows are such places). Strings are judged on the input; texts are UTF-8 bytes, null
    and shorter ones lose nothing. Null and repeated ids give a row each; other columns are not read.
    Equality of windows is by 128 bits of hash where they are not compared, and of texts by MD5.
    """
    texts, spans = repeated_spans(documents, text_col)
    cut = _picked(texts, spans.select("text_id")).join(spans, "text_id").select("text_id", "text", "spans")
    cut = cut.mapInArrow(_cut, "text_id binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    described = documents.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(body)).alias("text_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"), *([body.alias("body")] if keep_bytes else []))
    rows = stored(described)
    cut = stored((cut if keep_bytes else cut.drop("kept")).join(rows.groupBy("text_id").agg(F.count("*").alias("rows")), "text_id"))
    out = lookup(rows, cut, ["text_id"], "rows", rows.count(), how="left")
    zero = F.lit(0).cast("long")
    chosen = [F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select("doc_id", "n_bytes", *chosen, *([F.coalesce("kept", "body").alias("kept")] if keep_bytes else []))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
