"""Prefix trie of conversations: balanced parentheses per shard, whose shared spines are merged shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import lookup, partitions, stored

#: Turns of a shard, and the paths it has at least, however long they are.
SHARD, SHARD_ROWS = 1 << 18, 1000
#: Bits of a block of the min-max tree over the excess.
BLOCK = 64
#: Conversations that share turns with their first one, and the most turns they share less one.
FAMILY, SHARED = 100, 6
_MOST = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with its excess, and a tree of the least excess of its blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.leaves = 1 << max(0, int(-(-len(bits) // block) - 1).bit_length())
        padded = np.full(self.leaves * block, _MOST)
        padded[: len(bits)] = self.excess
        self.least = np.full(2 * self.leaves, _MOST)
        self.least[self.leaves :] = padded.reshape(self.leaves, block).min(axis=1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            i = np.arange(1 << level, 2 << level)
            self.least[i] = np.minimum(self.least[2 * i], self.least[2 * i + 1])
        self.padded = padded

    def _scan(self, at: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First place from ``at`` on, in its block, with the excess wanted; -1 if there is none. All move together."""
        out = np.full(len(at), -1)
        left = np.arange(len(at))
        at = at.copy()
        while len(left):
            hit = self.padded[at[left]] == want[left]
            out[left[hit]] = at[left[hit]]
            at[left] += 1
            left = left[~hit & (at[left] % self.block != 0)]
        return out

    def close(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at ``opens`` close: the next place whose excess is one less than theirs."""
        want = self.excess[opens] - 1
        out = self._scan(opens, want)
        far = np.flatnonzero(out < 0)
        node, goal = opens[far] // self.block + self.leaves + 1, want[far]
        while (wrong := self.least[node] > goal).any():  # to the right, over the largest runs of blocks that start there
            wide = node // (node & -node)
            node = np.where(wrong, np.where(self.least[wide] <= goal, wide, wide + 1), node)
        while (inner := node < self.leaves).any():
            left = 2 * np.where(inner, node, 0)
            node = np.where(inner, np.where(self.least[left] <= goal, left, left + 1), node)
        out[far] = self._scan((node - self.leaves) * self.block, goal)
        return out


@dataclass
class Paths:
    """Paths in order, one after the other. ``key``: two halves of a turn's digest; ``chars``: its code points. The rest stands for every
    depth from 0 on: what hangs at that node beside the paths given. ``ids``: the conversation that ends with the path, if paths are
    conversations."""

    n: np.ndarray
    key: np.ndarray
    chars: np.ndarray
    convs: np.ndarray
    kids: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    least: np.ndarray
    ids: np.ndarray | None = None


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _least_of(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of each range [first, last), none of them empty, by runs of powers of two."""
    size = last - first
    out = np.empty(len(first), values.dtype)
    run, table = 1, values
    while True:
        own = np.flatnonzero((size >= run) & (size < 2 * run))
        out[own] = np.minimum(table[first[own]], table[last[own] - run])
        if 2 * run > len(values):
            return out
        table, run = np.minimum(table[:-run], table[run:]), 2 * run


class Shard:
    """The trie of some paths that follow each other. Nodes are numbered in order of opening, the root first."""

    def __init__(self, p: Paths):
        self.paths = p
        rows = len(p.n)
        start = np.cumsum(p.n) - p.n
        both = np.minimum(p.n[1:], p.n[:-1])
        at = _spread(np.zeros(len(both), np.int64), both)
        differ = (p.key[np.repeat(start[1:], both) + at] != p.key[np.repeat(start[:-1], both) + at]).any(axis=1)
        shared = both.copy()
        np.minimum.at(shared, np.repeat(np.arange(len(both)), both)[differ], at[differ])
        shared = np.concatenate([[-1], shared])
        opened, closed = p.n - shared, np.append(0, p.n[:-1] - shared[1:])
        bits = np.repeat(np.tile([0, 1], rows), np.stack([closed, opened], axis=1).ravel())
        bits = np.concatenate([bits, np.zeros(int(p.n[-1]) + 1, np.int64)]).astype(np.int8)
        tree = Parentheses(bits)
        opens = np.flatnonzero(bits)
        closes = tree.close(opens)
        self.size = len(opens)
        own = np.arange(self.size)
        self.row = np.repeat(np.arange(rows), opened)  # the path that opened it
        self.depth = _spread(shared + 1, opened)
        self.turn = np.where(self.depth > 0, start[self.row] + self.depth - 1, -1)
        self.after = own + (closes - opens + 1) // 2  # number of the first node behind its subtree
        self._order = np.argsort(self.depth, kind="stable")
        self._code = self.depth[self._order] * self.size + self._order
        self.parent = np.where(self.depth > 0, self._at(self.depth - 1, own), -1)
        upto = np.cumsum(opened) - 1
        if p.ids is None:
            node = self._at(_spread(np.zeros(rows, np.int64), p.n + 1), np.repeat(upto, p.n + 1))
        else:
            node = self._at(p.n, upto)
        self.end = node
        add = lambda x: _added(node, x, self.size)
        self.kids = np.bincount(self.parent[1:], minlength=self.size) + add(p.kids)
        # Leaf pairs: an opening parenthesis that closes at once, where nothing else hangs below.
        self.leaf = (bits[opens + 1] == 0) & (self.kids == 0)
        under = lambda x: (c := np.append(0, np.cumsum(x)))[self.after] - c[own]
        self.convs = under(add(p.convs))
        chars = np.append(p.chars, 0)[self.turn]  # the root has no text
        self.own_saved = (self.convs - 1) * chars
        self.saved = under(self.own_saved + add(p.saved))
        self.leaves = under(self.leaf + add(p.leaves))
        least = np.full(self.size, _MOST)
        np.minimum.at(least, node, p.least)
        self.least = _least_of(least, own, self.after)

    def _at(self, depth: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The last node of that depth up to that number."""
        return self._order[np.searchsorted(self._code, depth * self.size + upto, side="right") - 1]

    def spine(self, last: bool) -> np.ndarray:
        """Nodes of the first or the last path, from the root on."""
        node, out = (self.size - 1 if last else int(self.paths.n[0])), []
        while node >= 0:
            out.append(node)
            node = int(self.parent[node])
        return np.array(out[::-1])


def _added(node: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, node, x)
    return out


def _names(keys: np.ndarray, parents: np.ndarray, out: dict[int, bytes], nodes: np.ndarray, turn: np.ndarray) -> None:
    """Name of a node: digest of its parent's name and its own turn; parents come before their children."""
    for node in nodes.tolist():
        if node not in out:
            above = int(parents[node])
            out[node] = b"" if above < 0 else hashlib.md5(out[above] + keys[turn[node]].tobytes(), usedforsecurity=False).digest()


_NODE, _SPINE, _PIECE = 0, 1, 2
_DEEP = ["chars", "convs", "kids", "leaves", "saved", "least"]
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = f"kind int, place long, keys array<binary>, {', '.join(f'{k} array<long>' for k in _DEEP)}, {', '.join(f'{k} long' for k in _RESULT)}, ends_sha256 string, name binary, above binary, ends binary"
_TYPES = {"kind": pa.int32(), "place": pa.int64(), "keys": pa.list_(pa.binary()), **{k: pa.list_(pa.int64()) for k in _DEEP}, **dict.fromkeys(_RESULT, pa.int64()), "ends_sha256": pa.string(), "name": pa.binary(), "above": pa.binary(), "ends": pa.binary()}


def _table(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], names=list(_TYPES))


def _shard_rows(place: int, p: Paths, whole: bool) -> Iterator[pa.RecordBatch]:
    """What a shard gives: finished nodes; the paths along its two borders, which other shards may share, with what hangs at them;
    and, for conversations, the ends at those nodes. ``whole``: nothing lies outside this shard."""
    s = Shard(p)
    sides = [] if whole else [s.spine(False), s.spine(True)]
    border = np.zeros(s.size, bool)
    for nodes in sides:
        border[nodes] = True
    names: dict[int, bytes] = {}
    merged = p.ids is None  # all nodes were on borders before: others ask for them by name
    _names(p.key, s.parent, names, np.arange(s.size) if merged else np.flatnonzero(border), s.turn)
    ends = np.full(s.size, None if merged else _NO_ENDS, object)
    if not merged:
        at, first = np.unique(s.end, return_index=True)  # conversations that end at one node follow each other
        for node, a, b in zip(at.tolist(), first.tolist(), _ends_of(first, at, len(s.end)), strict=True):
            text = ",".join(map(str, p.ids[a:b].tolist())).encode()
            if border[node]:
                yield _table(_PIECE, 1, place=[place], name=[names[node]], ends=[text])
            else:
                ends[node] = hashlib.sha256(text).hexdigest()
    done = np.flatnonzero(~border)
    parent = s.parent[done]
    open_ = (parent >= 0) & border[np.maximum(parent, 0)]
    above = np.where(open_ | (parent < 0), _MOST, s.least[np.maximum(parent, 0)])
    values = {"conv_id": s.least[done], "depth": s.depth[done], "n_convs": s.convs[done], "n_children": s.kids[done], "n_leaves": s.leaves[done], "saved_tokens": s.saved[done]}
    values["parent_conv_id"] = pa.array(above, pa.int64(), mask=above == _MOST)
    values["above"] = [names[x] if o else None for x, o in zip(parent.tolist(), open_.tolist(), strict=True)]
    if merged:
        values["name"] = [names[x] for x in done.tolist()]
    for a in range(0, len(done), 1 << 16):
        part = {k: v[a : a + (1 << 16)] for k, v in values.items()}
        yield _table(_NODE, len(part["depth"]), ends_sha256=ends[done[a : a + (1 << 16)]], **part)
    told = np.zeros(s.size, bool)
    below = np.flatnonzero(border & (s.parent >= 0))
    less = lambda x: x - _added(s.parent[below], x[below], s.size)  # noqa: E731  without the borders' own children
    hangs = {"convs": less(s.convs), "kids": s.kids - np.bincount(s.parent[below], minlength=s.size), "leaves": less(s.leaves) - s.leaf, "saved": less(s.saved) - s.own_saved, "least": s.least}
    for side, nodes in enumerate(sides):
        if side and told[nodes].all():
            break
        turn = s.turn[nodes[1:]]
        deep = {k: [np.where(told[nodes], _MOST if k == "least" else 0, v[nodes])] for k, v in hangs.items()}
        yield _table(_SPINE, 1, place=[2 * place + side], keys=[[x.tobytes() for x in p.key[turn]]], chars=[p.chars[turn]], **deep)
        told[nodes] = True


def _ends_of(first: np.ndarray, at: np.ndarray, n: int) -> list[int]:
    """For runs of rows given by their first rows: where each ends."""
    order = np.argsort(first)
    out = np.empty(len(first), np.int64)
    out[order] = np.append(first[order][1:], n)
    return out.tolist()


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a column of lists."""
    return np.diff(column.offsets.to_numpy()), column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())


def _paths(batch: pa.RecordBatch) -> Paths:
    """Columns: keys, chars, then conv_id, or what hangs at each depth."""
    n, keys = _flat(batch.column(0))
    key = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
    n, chars = n.astype(np.int64), _flat(batch.column(1))[1].to_numpy(zero_copy_only=False).astype(np.int64)
    if batch.num_columns == 3:
        ids, zero = batch.column(2).to_numpy().astype(np.int64), np.zeros(len(n), np.int64)
        return Paths(n, key, chars, zero + 1, zero, zero, zero, ids, ids)
    return Paths(n, key, chars, *(_flat(batch.column(i))[1].to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2, 7)))


def _joined(parts: list[Paths]) -> Paths:
    return Paths(*(None if getattr(parts[0], f.name) is None else np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Paths)))


def _sharded(batches: Iterator[pa.RecordBatch], whole: bool, most_turns: int, least_rows: int) -> Iterator[pa.RecordBatch]:
    place, held, turns, rows = TaskContext.get().partitionId() << 32, [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, least_rows):
            held.append(_paths(batch.slice(a, least_rows)))
            turns, rows = turns + len(held[-1].key), rows + len(held[-1].n)
            if not whole and rows >= least_rows and turns + rows >= most_turns:
                yield from _shard_rows(place, _joined(held), whole)
                place, held, turns, rows = place + 1, [], 0, 0
    if held:
        yield from _shard_rows(place, _joined(held), whole)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of name and place -> one digest a name; one piece is held at a time."""
    at, state, out = None, None, []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["name", "ends_sha256"])

    for batch in batches:
        for name, ends in zip(batch.column(0), batch.column(2), strict=True):
            name = name.as_py()
            if state is not None and name == at:
                state.update(b",")
            else:
                if state is not None:
                    out.append((at, state.hexdigest()))
                at, state = name, hashlib.sha256()
            state.update(ends.as_py())
        if out:
            yield table()
            out = []
    if state is not None:
        out.append((at, state.hexdigest()))
        yield table()


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, keys, chars``: every conversation's turns in order, each as a digest of role and text with the text's code points.

    A conversation c takes its first h turns from conversation c - c % 100 (all if there are fewer, none if there is no such
    conversation) and the others from itself, h = crc32 of c as text % 6. Turns are ordered by ``turn``, null first; rows of one turn by
    their digest. Null roles and texts are empty. Rows without an id belong to no conversation.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(part(role_col)).cast("string"), F.lit(":"), part(role_col), part(text_col))))
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("key"), F.char_length(part(text_col)).cast("long").alias("chars")).alias("t")
    )
    own = stored(turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("own")))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("own", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    none: Column = F.slice("own", 1, 0)
    both = own.withColumn("first", first).join(heads, "first", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).alias("path")
    )
    return both.select("conv_id", F.col("path.key").alias("keys"), F.col("path.chars").alias("chars"))


def prefix_trie(paths: DataFrame, most_turns: int = SHARD, least_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of ``paths`` (``conv_id`` different and not null, ``keys``, ``chars``): ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Paths are sorted over the cluster by turns and id, so that every task has a stretch of the trie in depth-first order, which it
    cuts into shards of ``most_turns`` turns (and ``least_rows`` paths at least). A shard is a balanced-parentheses sequence: its closing parentheses delimit the
    subtrees, leaf pairs are counted by rank, savings are differences of cumulated sums. Only nodes on the paths along a shard's
    borders can belong to other shards too. These paths, two a shard, with what hangs at them, are the input of the next round,
    in which many borders form one shard, until one shard holds all. Equal paths may fill many shards: the ids that end at a
    border node are pieces of text, sorted and joined by the shards, that one task a node only hashes in order.
    Nodes below a border node are joined to it by name; popular names are broadcast, fewer than a thousand (``lookup``). Turns and names are
    known by digests of 128 bits. A path is held in one row, about 50 bytes a turn. Every round is a written table.
    An empty table has no nodes.
    """
    spark = paths.sparkSession
    columns = ["keys", "chars"]
    rows = stored(paths.select(*columns, "conv_id"))
    level = stored(rows.repartitionByRange(partitions(spark), "keys", "conv_id").sortWithinPartitions("keys", "conv_id").mapInArrow(lambda it: _sharded(it, False, most_turns, least_rows), _SCHEMA))
    levels, order = [level], F.col("place")
    while True:
        border = level.filter(F.col("kind") == _SPINE).select("place", *columns, *_DEEP[1:])
        n, turns = border.agg(F.count("*"), F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()
        if not n:
            break
        tasks = min(-(-turns // most_turns), n // (2 * least_rows))
        whole = tasks <= 1
        dealt = border.coalesce(1) if whole else border.repartitionByRange(int(tasks), order)
        level = stored(dealt.sortWithinPartitions(order).drop("place").mapInArrow(lambda it, whole=whole: _sharded(it, whole, most_turns, least_rows), _SCHEMA))
        levels.append(level)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    nodes = every.filter(F.col("kind") == _NODE).select(*_RESULT, "ends_sha256", "name", "above")
    pieces = levels[0].filter(F.col("kind") == _PIECE).select("name", "place", "ends")
    ends = stored(pieces.repartition(partitions(spark), "name").sortWithinPartitions("name", "place").mapInArrow(_hashed, "name binary, ends_sha256 string"))
    named = stored(nodes.filter("name is not null").drop("ends_sha256").join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))))
    every = nodes.filter("name is null").unionByName(named)
    parents = named.select(F.col("name").alias("above"), F.col("conv_id").alias("parent"), F.col("n_children").alias("held"))
    below = every.filter("above is not null")
    # A node has as many rows below it as children, so their sum is the number of rows to be joined, or a little more.
    found = lookup(below, parents, ["above"], "held", below.count()).withColumn("parent_conv_id", F.col("parent"))
    result = [*_RESULT, "ends_sha256"]
    return every.filter("above is null").select(*result).unionByName(found.select(*result))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: crc32 of the digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)), lambda s, x: list_reduce(list_prepend(xor(s, x), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT)"
TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'k': k, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, k) AS l FROM t GROUP BY c),
cut AS (SELECT c, l, ({_CRC} % 6)::BIGINT AS h FROM own),
path AS (SELECT a.c, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS p FROM cut a LEFT JOIN own b ON b.c = a.c - a.c % 100),
place AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM path),
node AS (
  SELECT d, list_transform(p[1:d], lambda x: {{'role': x.role, 'text': x.text}}) AS p, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(place.p) = d), '')) AS ends_sha256
  FROM place GROUP BY ALL),
own_saved AS (SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].text) END AS s FROM node),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT o.*, coalesce(k.n, 0) AS n_children FROM own_saved o LEFT JOIN kids k USING (d, p)),
up AS (SELECT unnest(range(0, d + 1)) AS e, p, s, n_children FROM full_),
sums AS (SELECT e AS d, p[1:e] AS p, sum(s) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM up GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums u USING (d, p) LEFT JOIN node q ON q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]
"""
