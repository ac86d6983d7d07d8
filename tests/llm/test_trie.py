"""The prefix trie against its SQL, a plain trie, and plain parentheses."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from kinpanel.llm.trie import TRIE_SQL, Parentheses, Paths, Shard, op12_prefix_trie, prefix_trie, rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract with a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path) == d))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        above = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), above, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, rng):
    """Conversations with shared starts, copies, missing bases, null fields, and one long one."""
    texts = ["", "a", "bb", "ünï\U0001f600", "x" * 50]
    out = []
    for c in rng.choice(np.arange(-300, 3000), n, replace=False).tolist():
        size = int(rng.integers(1, 9)) if c % 3 else 4
        for t in range(size):
            text = texts[int(rng.integers(0, 5))] if c % 3 else "copy"
            out.append((c, None if t == 0 and c % 7 == 0 else t, ["user", "assistant", None][t % 3], None if text == "a" and c % 5 == 0 else text))
    out += [(5000, t, "user", f"turn {t}") for t in range(120)]
    out += [(None, 0, "user", "nobody's"), (7000, 0, "user", "twice"), (7000, 0, "user", "twice"), (7000, 0, "system", "tie")]
    return out


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"most_turns": 60, "least_rows": 3}])
def test_against_a_plain_trie(spark, sizes):
    rows = made(700, np.random.default_rng(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_trie(rebuilt(df), **sizes)) == plain(rows)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{sf}/conversations.parquet'")
    assert found(op12_prefix_trie(spark, sf)) == sorted(con.execute(TRIE_SQL).fetchall(), key=str)


def test_one_path_over_many_shards(spark):
    rows = [(100 * i, t, "user", f"same {t}") for i in range(400) for t in range(3)]
    out = found(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)), most_turns=20, least_rows=2))
    assert out == plain(rows) and len(out) == 4


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie(rebuilt(none))) == []
    nobody = spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)
    assert found(prefix_trie(rebuilt(nobody))) == []
    # All turns of 101 are replaced by those of 100, which is not there: only the root is left.
    assert zlib.crc32(b"101") % 6 >= 1
    alone = [(101, 0, None, None)]
    assert found(prefix_trie(rebuilt(spark.createDataFrame(alone, SCHEMA)))) == plain(alone) == [(101, 0, None, 1, 0, 1, 0, hashlib.sha256(b"101").hexdigest())]
    wide = spark.createDataFrame([(*r, "x", "y", "z") for r in made(30, np.random.default_rng(1))], SCHEMA + ", keys string, first string, own string")
    assert found(prefix_trie(rebuilt(wide))) == plain(made(30, np.random.default_rng(1)))


@pytest.mark.parametrize("block", [1, 4, 64])
def test_parentheses(block):
    rng = np.random.default_rng(9)
    for n in (1, 2, 30, 700):
        bits, depth, left = [], 0, n
        while left or depth:
            if left and (not depth or rng.random() < 0.5 + 0.4 * (n == 700)):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(0)
                depth -= 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        bits = np.array(bits, np.int8)
        opens = np.flatnonzero(bits)
        assert Parentheses(bits, block).close(opens).tolist() == [close[i] for i in opens.tolist()]


def test_what_hangs_below_counts(spark):
    """A node that is childless among the paths given is no leaf when something hangs at it."""
    one = np.ones(2, np.int64)
    zero = np.zeros(2, np.int64)
    s = Shard(Paths(np.array([1]), np.array([[1, 2]], np.uint64), np.array([5]), one * 3, np.array([0, 2]), np.array([0, 2]), zero, np.array([4, 1])))
    assert s.leaves.tolist() == [2, 2] and s.kids.tolist() == [1, 2] and s.convs.tolist() == [6, 3] and s.least.tolist() == [1, 1] and s.saved.tolist() == [10, 10]
