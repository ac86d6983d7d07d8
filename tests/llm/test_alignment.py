"""Token alignment against the public libraries and a plain merge."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from kinpanel.llm import alignment
from kinpanel.llm.alignment import BYTE_MODEL, PIECE_MODEL, Groups, align, byte_level, lockstep, op11_token_alignment, piece_level

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
TEXTS = ["<|endoftext|> and <s> </s> <unk> <0x41>", "一二三 \U0001f600\U0001f600 é" * 5, "a\x00b \t\n  c", "x" * 5000 + " " * 3000, "naïve▁piece", "'s 't it's 12345678 ...!!", " lead", "aaab" * 900]


def plain(rows):
    """The contract, one document after the other."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(BYTE_MODEL)
    left.encode_special_tokens = True
    right = SentencePieceProcessor(model_file=PIECE_MODEL)
    of = alignment._byte_alphabet()
    found, held, links_of = [], Counter(), []
    for doc, text in rows:
        a = b = []
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            x = [bytes(of[c] for c in left.id_to_token(i)) for i in a]
            y = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, right.id_to_piece(b), strict=True)]
            if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
                a = b = []
        if not a:
            found.append([doc, 0, 0, 0, 0, 0, 0, "", 0])
            links_of.append([])
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        names, links, overlaps, low = [], [], 0, 0
        for cut in cuts:
            g = [ids[bisect_right(end, low) : bisect_right(end, cut)] for ids, end in zip((a, b), ends, strict=True)]
            names.append("|".join(",".join(map(str, s)) for s in g))
            links += [(p, q) for p in g[0] for q in g[1]]
            low = cut
        i = j = 0
        while i < len(a):
            overlaps, p, q = overlaps + 1, ends[0][i], ends[1][j]
            i, j = i + (p <= q), j + (q <= p)
        links_of.append(links)
        held.update(set(links))
        found.append([doc, len(a), len(b), len(cuts), len(links), 0, 0, hashlib.sha256(";".join(names).encode()).hexdigest(), overlaps])
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    for row, links in zip(found, links_of, strict=True):
        row[5] = sum(held[x] == most[x[0]] for x in links)
        row[6] = sum(held[x] for x in links)
    return sorted(map(tuple, found), key=str), {(p, q): (n, n == most[p]) for (p, q), n in held.items()}


def rows(df):
    return sorted((tuple(r[c] for c in ["doc_id", *NAMES]) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_merge(spark, odd, small):
    sizes = {"block_bytes": 2000, "chunk_bytes": 6000} if small else {}
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    texts = [(100 + i, t) for i, t in enumerate(TEXTS)]
    short = odd.select("doc_id", "text").filter("text is null or length(text) < 10000")
    docs = given.unionByName(short).unionByName(spark.createDataFrame(texts, "doc_id long, text string")).repartition(3)
    figures, links = align(docs, **sizes)
    expected, pairs = plain([(r[0], r[1]) for r in docs.collect()])
    assert rows(figures) == expected
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in links.collect()} == pairs


def test_lockstep_by_lanes():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 40)
    ends, starts = [[], []], []
    for base, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        starts.append(len(ends[0]))
        for side in ends:
            side += [int(base) + e for e in sorted({int(n), *rng.integers(1, n + 1, rng.integers(1, n + 1)).tolist()})]
    a, b = np.array(ends[0]), np.array(ends[1])
    whole = lockstep(a, b, np.array(starts), 1 << 40)
    for lane in (1, 2, 7, 100):
        some = lockstep(a, b, np.array(starts), lane)
        assert sorted(zip(some[0].tolist(), some[1].tolist(), strict=True)) == sorted(zip(whole[0].tolist(), whole[1].tolist(), strict=True))
        assert np.array_equal(some[2], whole[2]) and np.array_equal(some[3], whole[3])
    assert a[whole[2]].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert lockstep(a[:0], b[:0], np.array([], np.int64))[2].tolist() == []


def test_pairs_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    n_a, n_b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    g = Groups(rng.integers(0, 4, n_a.sum()), n_a, rng.integers(0, 4, n_b.sum()), n_b)
    whole = g.pairs()
    monkeypatch.setattr(alignment, "_SLICE", 7)
    assert all(np.array_equal(x, y) for x, y in zip(whole, g.pairs(), strict=True))
    assert whole[2].sum() == (n_a * n_b).sum()


def test_groups_are_told_apart_by_their_ids():
    g = Groups(np.array([1, 2, 1, 2, 1, 2, 7]), np.array([2, 2, 1, 2]), np.array([3, 3, 3, 4, 3]), np.array([1, 1, 2, 1]))
    different, number = g.distinct()
    assert len(different) == 3 and number[0] == number[1] and len({int(x) for x in number}) == 3
    assert sorted(different.texts()) == ["1,2|3", "1|3,4", "2,7|3"]
    group, pair, times = Groups(np.array([1, 1, 2]), np.array([3]), np.array([5, 5]), np.array([2])).pairs()
    assert [(int(g), int(p >> 32), int(p & 0xFFFFFFFF), int(t)) for g, p, t in zip(group, pair, times, strict=True)] == [(0, 1, 5, 4), (0, 2, 5, 2)]


def test_the_fast_encoder_is_the_files_own():
    from tokenizers import Tokenizer

    with open(BYTE_MODEL, encoding="utf-8") as f:
        content = f.read()
    own = Tokenizer.from_file(BYTE_MODEL)
    own.encode_special_tokens = True
    fast, table = byte_level(content)
    rng = np.random.default_rng(3)
    points = [c for c in rng.integers(1, 0x110000, 4000).tolist() + list(range(1, 0x3000)) if not 0xD800 <= c < 0xE000]
    for c in points:
        text = f" x{chr(c)}y {chr(c)}1{chr(c)}  {chr(c)}'s\n{chr(c)}"
        assert fast(text) == own.encode(text, add_special_tokens=False).ids
    assert b"".join(table[i] for i in fast(" naïve\x00 一")) == " naïve\x00 一".encode()
    with open(PIECE_MODEL, "rb") as f:
        _, pieces = piece_level(f.read())
    assert pieces[3] == b"\x00"


def test_edges(spark, none, clash, odd_path, tmp_path):
    figures, links = align(none)
    assert figures.collect() == [] and links.collect() == []
    figures, _ = align(clash.filter("text is null or length(text) < 10000"))
    assert figures.columns[0] == "doc_id" and figures.count() == clash.filter("text is null or length(text) < 10000").count()
    nulls = spark.createDataFrame([(None, None), (None, ""), (1, None)], "doc_id long, text string")
    assert rows(align(nulls)[0]) == sorted([(i, 0, 0, 0, 0, 0, 0, "", 0) for i in (None, None, 1)], key=str)
    out = op11_token_alignment(spark, odd_path)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    long = {r["doc_id"]: r for r in out.collect()}[10]
    assert long["n_groups"] > 60_000 and long["n_links"] >= long["n_overlaps"] >= max(long["n_a"], long["n_b"])
