"""Alignment of two tokenizers' tokens: documents merged in lockstep by byte offsets, links counted over the corpus."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import partitions, stored

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are merged at a time, and that form a chunk, whose pairs are counted together.
BLOCK_BYTES, CHUNK_BYTES = 3 << 20, 24 << 20
#: Tokens of A that one state advances over: a longer document has several states.
LANE = 256
#: Pairs that are laid out at a time.
_SLICE = 1 << 21
#: The split of byte-level BPE files that ask for the usual rule.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encoder = Callable[[str], list[int]]


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(content: str) -> tuple[Encoder, list[bytes]]:
    """Encoder without special tokens and the bytes of every id, of a byte-level BPE file.

    Files whose ids stand in the order of their merges are run by the faster of the two public libraries, which gives the same
    ids; all others by the file's own library.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(content)
    own.encode_special_tokens = True
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    of = _byte_alphabet()
    vocab = own.get_vocab(with_added_tokens=True)
    added = {t["content"] for t in json.loads(content)["added_tokens"]}
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for text, i in vocab.items():
        table[i] = text.encode() if text in added else bytes(of[c] for c in text)
    spec, split = json.loads(content), {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"].get(a + b, -1) for a, b in merges]
    rest = len(spec["model"]["vocab"]) - len(ids)
    plain = spec["normalizer"] is None and all((spec["pre_tokenizer"] or {}).get(k) == v for k, v in split.items()) and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or rest != 256 or ids != list(range(256, 256 + len(ids))):
        return slow, table
    import tiktoken

    ranks = {table[i]: i for i in range(256 + len(ids))}
    fast = tiktoken.Encoding("byte level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary, table


@lru_cache(maxsize=2)
def piece_level(content: bytes) -> tuple[Encoder, list[bytes]]:
    """Encoder and the bytes of every id, of a SentencePiece file: the space sign is a space, <0xHH> is the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))]
    return (lambda text: model.encode(text, num_threads=1)), table


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges the tokens of all documents of a batch at once: links (numbers of A and B tokens whose bytes overlap, in no order) and
    cuts (numbers of the A and B tokens that end where a cut is, in order).

    ``ends_a`` and ``ends_b`` are byte offsets where tokens end, over all documents one after the other, which have the same bytes
    in both; ``starts_a`` are the numbers of their first A tokens. The state holds a pointer to A and one to B for each
    document, or for each ``lane`` A tokens of a longer one. In each step every state emits the link of its two
    tokens, and a cut if both end at one place; then the token that ends first gives way (both at a cut). States at their end
    leave the vector.
    """
    bounds = np.append(starts_a, len(ends_a))
    pieces = -(-np.diff(bounds) // lane)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    i = np.repeat(starts_a, pieces) + lane * (np.arange(len(first)) - first)
    stop = np.append(i[1:], len(ends_a))[: len(i)]
    below = np.where(i > 0, ends_a[np.maximum(i, 1) - 1], 0) if len(i) else i
    j = np.searchsorted(ends_b, below, side="right")
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(i):
        link_a.append(i.astype(np.int32))
        link_b.append(j.astype(np.int32))
        x, y = ends_a[i], ends_b[j]
        same = x == y
        cut_a.append(i[same])
        cut_b.append(j[same])
        i, j = i + (x <= y), j + (y <= x)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (link_a, link_b, cut_a, cut_b)]
    return both[0], both[1], np.sort(both[2]), np.sort(both[3])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (size of them) for each."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Groups:
    """Groups of tokens one after the other: ids of A and of B with the number of each in every group."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        self.at_a, self.at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b

    def __len__(self) -> int:
        return len(self.n_a)

    def take(self, which: np.ndarray) -> Groups:
        n_a, n_b = self.n_a[which], self.n_b[which]
        return Groups(self.a[_spread(self.at_a[which], n_a)], n_a, self.b[_spread(self.at_b[which], n_b)], n_b)

    def _equal(self, other: Groups) -> bool:
        same = np.array_equal(self.n_a, other.n_a) and np.array_equal(self.n_b, other.n_b)
        return same and np.array_equal(self.a, other.a) and np.array_equal(self.b, other.b)

    def distinct(self) -> tuple[Groups, np.ndarray]:
        """The different groups, and for each group its number among them. Hashes propose, the ids decide."""
        if not len(self):
            return self, np.empty(0, np.int64)
        place = [_spread(np.zeros(len(n), np.int64), n).astype(np.uint64) for n in (self.n_a, self.n_b)]
        for seed in range(1, 1 << 30):
            sums = []
            for side, (ids, where, at, n) in enumerate(((self.a, place[0], self.at_a, self.n_a), (self.b, place[1], self.at_b, self.n_b))):
                x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + where * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed + 7 * side)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
                sums.append(np.add.reduceat(x, at) * np.uint64(2 * side + 1) + n.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
            mixed = sums[0] ^ (sums[1] * np.uint64(0xD6E8FEB86659FD93))
            _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
            if self._equal(self.take(first[inverse])):
                return self.take(first), inverse.astype(np.int64)
        raise AssertionError("no seed tells the groups apart")

    def texts(self) -> list[str]:
        """``a1,a2|b1`` of every group."""
        out = []
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        for x, n, y, m in zip(self.at_a.tolist(), self.n_a.tolist(), self.at_b.tolist(), self.n_b.tolist(), strict=True):
            out.append(",".join(a[x : x + n]) + "|" + ",".join(b[y : y + m]))
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each group the different (A id, B id) pairs, as codes, with their number of places: group, code, number; ordered by group."""
        sides = []
        for ids, n in ((self.a, self.n_a), (self.b, self.n_b)):
            code, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids, return_counts=True)
            sides.append((code >> 32, code & 0xFFFFFFFF, times))
        (ga, a, ka), (gb, b, kb) = sides
        begin, size = np.searchsorted(gb, ga), np.bincount(gb, minlength=len(self))[ga] if len(ga) else ga
        out = []
        for s in _slices(size):
            at = _spread(begin[s], size[s])
            out.append((np.repeat(ga[s], size[s]), np.repeat(a[s], size[s]) << 32 | b[at], np.repeat(ka[s], size[s]) * kb[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Runs of entries whose sizes sum to about ``_SLICE``."""
    upto, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _SLICE, side="right")))
        yield slice(start, end)
        start = end


def _sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, weights=n, minlength=len(code)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    small = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in arrays]
    return zlib.compress(b"".join(len(x).to_bytes(8, "little") + x.dtype.str.encode() + x.tobytes() for x in small), 3)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 11].decode())
        out.append(np.frombuffer(raw, kind, n, at + 11).astype(np.int64))
        at += 11 + n * kind.itemsize
    return out


class Block:
    """Documents merged together: per document the figures, its groups (numbers and times), and pairs with the number of documents."""

    def __init__(self, ids: list, texts: list[bytes | None], a: tuple[Encoder, list[bytes]], b: tuple[Encoder, list[bytes]], sizes: tuple[np.ndarray, np.ndarray]):
        self.ids = ids
        tokens = [_tokens(text, a, b) for text in texts]
        self.n = [np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1)]
        ta, tb = (np.concatenate([t[side] for t in tokens]) if tokens else np.empty(0, np.int64) for side in (0, 1))
        full = np.flatnonzero(self.n[0])
        starts = (np.cumsum(self.n[0]) - self.n[0])[full]
        link_a, _, cut_a, cut_b = lockstep(np.cumsum(sizes[0][ta]), np.cumsum(sizes[1][tb]), starts)
        doc_of = np.repeat(np.arange(len(ids)), self.n[0])
        self.overlaps = np.bincount(doc_of[link_a], minlength=len(ids))
        doc = doc_of[cut_a]
        groups = Groups(ta, np.diff(cut_a, prepend=-1), tb, np.diff(cut_b, prepend=-1))
        self.groups, number = groups.distinct()
        self.n_groups = np.bincount(doc, minlength=len(ids))
        self.n_links = np.zeros(len(ids), np.int64)
        np.add.at(self.n_links, doc, groups.n_a * groups.n_b)
        names = self.groups.texts()
        ends = np.cumsum(self.n_groups)
        self.digests = [hashlib.sha256(";".join(map(names.__getitem__, number[e - n : e].tolist())).encode()).hexdigest() if n else "" for e, n in zip(ends.tolist(), self.n_groups.tolist(), strict=True)]
        # Different groups of each document, and from them its different pairs.
        code, self.times = np.unique(doc << 32 | number, return_counts=True)
        self.doc, self.number = code >> 32, code & 0xFFFFFFFF
        group, pair, _ = self.groups.pairs()
        kinds, pair = np.unique(pair, return_inverse=True)
        begin, size = np.searchsorted(group, self.number), np.bincount(group, minlength=len(self.groups))[self.number] if len(self.number) else self.number
        held, last = np.zeros(len(kinds), np.int64), np.append(np.flatnonzero(np.diff(self.doc)), len(self.doc) - 1) + 1 if len(self.doc) else self.doc
        per_doc = np.diff(np.cumsum(size)[last - 1], prepend=0) if len(last) else last
        row_of = np.append(0, last)
        for s in _slices(per_doc):
            rows = slice(row_of[s.start], row_of[s.stop])
            both = np.unique(np.repeat(self.doc[rows], size[rows]) << 32 | pair[_spread(begin[rows], size[rows])])
            held += np.bincount(both & 0xFFFFFFFF, minlength=len(kinds))
        self.pairs, self.held = kinds, held


def _tokens(text: bytes | None, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Ids by A and by B; none where the text is null, empty or no UTF-8, or where the tokens' bytes are not its own."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    try:
        plain = text.decode()
    except UnicodeDecodeError:
        return none
    whole = b" " + text
    left, right = a[0](" " + plain), b[0](plain)
    if b"".join(map(a[1].__getitem__, left)) != whole or b"".join(map(b[1].__getitem__, right)) != whole:
        return none
    return np.array(left, np.int64), np.array(right, np.int64)


_PAIR, _GROUPS, _DOC = 0, 1, 2


def _chunk_rows(chunk: int, blocks: list[Block], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A finished chunk: its pairs with their documents, its groups as pairs, its documents as groups."""
    every = [x.groups for x in blocks]
    groups, number = Groups(*(np.concatenate([getattr(g, k) for g in every]) for k in ("a", "n_a", "b", "n_b"))).distinct()
    codes, held = _sums(np.concatenate([x.pairs for x in blocks]), np.concatenate([x.held for x in blocks]))
    group, pair, times = groups.pairs()

    def table(which: int, n: int, **columns) -> pa.RecordBatch:
        def column(name: str, t: pa.DataType):
            return pa.array(columns[name], t) if name in columns else pa.nulls(n, t)

        types = {"place": pa.int32(), "a": pa.int32(), "b": pa.int32(), "docs": pa.int64(), "doc_id": kind, **dict.fromkeys(_FIGURES, pa.int64()), "groups_sha256": pa.string(), "data": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([which] * n, pa.int32()), *(column(k, t) for k, t in types.items())], names=["chunk", "kind", *types])

    for s in range(0, len(codes), 1 << 16):
        some = codes[s : s + (1 << 16)]
        yield table(_PAIR, len(some), place=np.arange(s, s + len(some)), a=some >> 32, b=some & 0xFFFFFFFF, docs=held[s : s + len(some)])
    yield table(_GROUPS, 1, place=[0], data=[_packed(np.bincount(group, minlength=len(groups)), np.searchsorted(codes, pair), times)])
    at = 0
    for x in blocks:
        new = number[at : at + len(x.groups)][x.number]
        at += len(x.groups)
        ends = np.searchsorted(x.doc, np.arange(len(x.ids) + 1))
        data = [None if e == f else _blob(new[e:f], x.times[e:f]) for e, f in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        figures = dict(zip(_FIGURES, (*x.n, x.n_groups, x.n_links, x.overlaps), strict=True))
        yield table(_DOC, len(x.ids), place=[0] * len(x.ids), doc_id=x.ids, groups_sha256=x.digests, data=data, **figures)


def _blob(number: np.ndarray, times: np.ndarray) -> bytes:
    order = np.argsort(number)
    return _packed(np.diff(number[order], prepend=0), times[order])


_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


def _merged(batches: Iterator[pa.RecordBatch], byte_file, piece_file, block_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    a, b = byte_level(byte_file.value), piece_level(piece_file.value)
    sizes = tuple(np.array([len(x) for x in t[1]], np.int64) for t in (a, b))
    chunk, kind = TaskContext.get().partitionId() << 32, pa.null()
    blocks, ids, texts, held, done = [], [], [], 0, 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            body = text.as_py()
            ids.append(doc.as_py())
            texts.append(body)
            held += len(body or b"") + 64
            if held >= block_bytes:
                blocks.append(Block(ids, texts, a, b, sizes))
                ids, texts, held, done = [], [], 0, done + held
            if done >= chunk_bytes:
                yield from _chunk_rows(chunk, blocks, kind)
                blocks, done, chunk = [], 0, chunk + 1
    if ids:
        blocks.append(Block(ids, texts, a, b, sizes))
    if blocks:
        yield from _chunk_rows(chunk, blocks, kind)


def _answered(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in order of chunk and kind: the chunk's pairs with their counts, its groups, then its documents."""
    counts, best, group_sum, group_best = [], [], np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        for start, end in zip(*_runs(kinds), strict=True):
            some, which = batch.slice(start, end - start), kinds[start]
            if which == _PAIR:
                counts.append(some.column(3).to_numpy(zero_copy_only=False))
                best.append(some.column(4).to_numpy(zero_copy_only=False))
            elif which == _GROUPS:
                n, best_ = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, best))
                size, pair, times = _unpacked(some.column(5)[0].as_py())
                group, (counts, best) = np.repeat(np.arange(len(size)), size), ([], [])
                # Whole numbers throughout: sums of a chunk may pass what a double holds exactly.
                group_sum, group_best = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                np.add.at(group_sum, group, times * n[pair])
                np.add.at(group_best, group, times * best_[pair])
            else:
                found = [(0, 0) if blob is None else _scores(_unpacked(blob), group_best, group_sum) for blob in some.column(5).to_pylist()]
                own = [some.column(6 + k) for k in range(len(names) - 2)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=names)


def _scores(held: list[np.ndarray], best: np.ndarray, total: np.ndarray) -> tuple[int, int]:
    number = np.cumsum(held[0])
    return int((best[number] * held[1]).sum()), int((total[number] * held[1]).sum())


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(x)) + 1
    return [0, *cut.tolist()] if len(x) else [], [*cut.tolist(), len(x)] if len(x) else []


def align(documents: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Figures of every document, and the corpus's links: ``a, b, n`` (documents that hold the pair linked) and ``best`` (none of
    the A id's pairs is in more documents).

    Figures, one row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum``. A encodes a
    space and the text, B the text (it adds the space itself), both without special tokens, whose strings in a text
    are plain text. Offsets where tokens of both end cut the tokens into groups; all pairs of an A and a B token of one group are
    links; ``n_overlaps`` counts those whose bytes overlap. A text that is null, empty, no UTF-8, or that either
    tokenizer changes, has no tokens: zeros and an empty digest. Repeated rows are documents of their own; null ids stay null.
    Other columns are not read. An empty table gives empty tables.

    Texts are read once, in blocks of ``block_bytes``, whose documents are merged in lockstep (see ``lockstep``). About ``chunk_bytes`` of
    text form a chunk, which counts its pairs, so that a pair is shuffled once a chunk however many documents hold it. The
    sums go back to the chunks, which are read in order: pairs, groups as pairs, documents as groups. A task holds one chunk's pairs and
    groups; documents pass by one batch after the other. Memory follows the longest text, about 60 bytes for each of its bytes.
    """
    spark = documents.sparkSession
    # The files are of fixed size, whatever the documents.
    with open(byte_model, encoding="utf-8") as f:
        byte_file = spark.sparkContext.broadcast(f.read())
    with open(piece_model, "rb") as f:
        piece_file = spark.sparkContext.broadcast(f.read())
    kind = documents.schema[id_col].dataType.simpleString()
    own = f"doc_id {kind}, {', '.join(f'{k} long' for k in _FIGURES)}, groups_sha256 string"
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = stored(rows.mapInArrow(lambda it: _merged(it, byte_file, piece_file, block_bytes, chunk_bytes), f"chunk long, kind int, place int, a int, b int, docs long, {own}, data binary"))
    pairs = parts.filter(F.col("kind") == _PAIR).select("chunk", "kind", "place", "a", "b", "docs")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    links = stored(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    names = ["doc_id", *_FIGURES, "groups_sha256", "n_best", "count_sum"]
    told = pairs.join(links, ["a", "b"]).select("chunk", "kind", "place", "n", F.col("best").cast("long").alias("best"))
    rest = parts.filter(F.col("kind") != _PAIR).select("chunk", "kind", "place", "data", *names[:-2])
    together = told.unionByName(rest, allowMissingColumns=True).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "kind", "place")
    return together.mapInArrow(lambda it: _answered(it, names), f"{own}, n_best long, count_sum long"), links


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    figures, _ = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return figures.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
