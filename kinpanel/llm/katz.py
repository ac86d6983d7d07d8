"""Language-model scoring with Katz backoff: bigrams over words, Good-Turing discounts, exactly normalised backoff weights."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinpanel.llm.common import partitions
from kinpanel.llm.language import held_out

#: Counts up to this are discounted; held-out documents are one in so many.
DISCOUNTED, FOLDS = 5, 10
#: A word that follows more than one in so many tokens is a hot context: its bigrams are dealt over all tasks.
HOT = 1000
#: Bytes of text a chunk should have at most.
CHUNK_BYTES = 64 << 20
START, END = (np.uint64(xxhash.xxh3_64_intdigest(b" " + s)) for s in (b"start", b"end"))  # no word has a blank


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _packed(value, level: int = 3) -> bytearray:
    return bytearray(zstandard.compress(pickle.dumps(value, 5), level))


def _unpacked(blob):
    return pickle.loads(zstandard.decompress(bytes(blob)))


def _ordered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes (not negative) in order and the place of each, equal ones by place. Code and place are sorted as one number if it fits."""
    bits = len(code).bit_length()
    if len(code) and int(code.max()).bit_length() + bits > 63:
        place = np.argsort(code, kind="stable")
        return code[place], place
    both = np.sort((code << bits) | np.arange(len(code)))
    return both >> bits, both & ((1 << bits) - 1)


class Chunk:
    """Documents of one partition as word numbers. Words are numbered in order of appearance; the end comes last. The chunk is
    built several times, and what was told of one building is laid over the next: blobs are taken in order of their places,
    since they arrive in any order."""

    def __init__(self, blobs):
        self.rows = [row for _, blob in sorted(blobs) for row in _unpacked(blob)]
        numbers: dict[bytes, int] = {}
        each = [np.array([numbers.setdefault(w, len(numbers)) for w in (body or b"").lower().split()], np.int32) for _, _, body in self.rows]
        self.rows = [row[:2] for row in self.rows]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
        self.hashes = np.append(self.hashes, END)
        end = len(numbers)
        self.sizes = np.array([len(x) + 1 for x in each], np.int64)
        last = np.array([end], np.int32)
        parts = [y for x in each for y in (x, last)]
        self.tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.doc = np.repeat(np.arange(len(self.rows), dtype=np.int32), self.sizes)
        self.train = np.array([not held for _, held in self.rows], bool)

    def bigrams(self):
        """(context, word, training count, number of places, documents of the places) of each distinct bigram; the
        context of a first word is numbered one above the end."""
        start = len(self.hashes)
        code = np.empty(len(self.tokens), np.int64)
        code[1:] = self.tokens[:-1]
        code[np.cumsum(self.sizes) - self.sizes] = start
        code, place = _ordered(code * (start + 1) + self.tokens)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
        docs, code = self.doc[place], code[first]
        trained = np.concatenate([[0], np.cumsum(self.train[docs])])
        ends = np.append(first[1:], len(docs))
        return code // (start + 1), code % (start + 1), trained[ends[: len(first)]] - trained[first], ends[: len(first)] - first, docs


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ranges(order_key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    if parts <= 1 << 16:  # numpy sorts numbers of 16 bits by their digits
        order_key = order_key.astype(np.uint16)
    order = np.argsort(order_key, kind="stable")
    ends = np.searchsorted(order_key[order].astype(np.int64), np.arange(parts + 1))
    for p in range(parts):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def _word_counts(index: int, blobs, parts: int):
    """The words of a chunk with their training counts, to the owners of the words."""
    chunk = Chunk(b for _, b in blobs)
    counts = np.bincount(chunk.tokens, weights=chunk.train[chunk.doc], minlength=len(chunk.hashes)).astype(np.int64)
    for p, rows in _ranges(_part(chunk.hashes, parts), parts):
        yield p, (index, _packed((chunk.hashes[rows], _small(counts[rows]))))


def _totals(requests) -> tuple[list, np.ndarray, np.ndarray]:
    asked = [(chunk, *_unpacked(blob)) for _, (chunk, blob) in requests]
    hashes = np.concatenate([a[1] for a in asked] or [np.empty(0, np.uint64)])
    counts = np.concatenate([a[2].astype(np.int64) for a in asked] or [np.empty(0, np.int64)])
    words, at = np.unique(hashes, return_inverse=True)
    return asked, words, np.bincount(at, weights=counts, minlength=len(words)).astype(np.int64)


def _count_stats(totals: np.ndarray) -> list[tuple[str, int]]:
    some = totals[totals > 0]
    r = np.bincount(some[some <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
    return [("tokens", int(some.sum())), ("types", len(some)), *((f"n{i}", int(r[i])) for i in range(1, DISCOUNTED + 2))]


def _word_stats(requests):
    _, words, totals = _totals(requests)
    yield from _count_stats(totals)


def _hot_words(requests, above: float):
    _, words, totals = _totals(requests)
    for i in np.flatnonzero(totals > above):
        yield int(words[i]), int(totals[i])


def _answers(requests):
    """Training counts of the words, back to each chunk that asked, in the order asked."""
    parts = list(requests)
    asked, words, totals = _totals(parts)
    for (p, _), (chunk, hashes, _) in zip(parts, asked, strict=True):
        yield chunk, (p, _packed(_small(totals[np.searchsorted(words, hashes)])))


def _known(chunk: Chunk, answers, parts: int) -> np.ndarray:
    """Training counts of the chunk's words."""
    found = {p: _unpacked(blob) for _, (p, blob) in answers}
    out = np.zeros(len(chunk.hashes), np.int64)
    for p, rows in _ranges(_part(chunk.hashes, parts), parts):
        out[rows] = found[p]
    return out


def _bigrams(index: int, pair, parts: int, hot: set[int]):
    """Distinct bigrams of a chunk with the counts of their second words and the documents that have them, to the owner of
    their context; bigrams of hot contexts are dealt by both words."""
    blobs, answers = pair
    chunk = Chunk(b for _, b in blobs)
    known = _known(chunk, answers, parts)
    context, word, seen, places, docs = chunk.bigrams()
    hashes = np.append(chunk.hashes, START)
    h, w = hashes[context], hashes[word]
    isin = np.isin(hashes, np.array(sorted(hot), np.uint64))[context]
    where = _part(np.where(isin, (h ^ (w << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15), h), parts)
    begins = np.concatenate([[0], np.cumsum(places)])
    for p, rows in _ranges(where, parts):  # rows stay in order of context
        own, lengths = h[rows], places[rows]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        take = np.repeat(begins[rows], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        low = np.ascontiguousarray(w[rows]).view(np.uint8).reshape(-1, 8)[:, :6]
        runs = np.diff(np.append(new, len(rows)))
        yield p, (index, len(chunk.rows), _packed((own[new], _small(runs), np.ascontiguousarray(low), _small(known[word[rows]]), _small(seen[rows]), _small(lengths), _small(docs[take]))))


class Owned:
    """All bigrams of the contexts a task owns (and its share of those of hot contexts), over all chunks."""

    def __init__(self, sent):
        self.sent = [(chunk, n, _unpacked(blob)) for _, (chunk, n, blob) in sent]
        get = lambda i: np.concatenate([s[2][i] for s in self.sent]) if self.sent else np.empty(0, np.int64)
        h = np.concatenate([np.repeat(s[2][0], s[2][1].astype(np.int64)) for s in self.sent]) if self.sent else np.empty(0, np.uint64)
        low = np.zeros((len(h), 8), np.uint8)
        if self.sent:
            low[:, :6] = get(2)
        w = low.view(np.uint64)[:, 0]
        order = np.lexsort((w, h))
        h_, w_ = h[order], w[order]
        new = np.concatenate([[True], (h_[1:] != h_[:-1]) | (w_[1:] != w_[:-1])]) if len(h) else np.empty(0, bool)
        self.row = np.empty(len(h), np.int64)  # distinct bigram of each told bigram
        self.row[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.count = np.bincount(self.row, weights=get(4).astype(np.int64), minlength=len(first)).astype(np.int64)
        self.word_count = get(3)[order][first].astype(np.int64)
        begin = np.concatenate([[True], h_[first][1:] != h_[first][:-1]]) if len(first) else np.empty(0, bool)
        self.context = np.cumsum(begin) - 1
        self.contexts = h_[first][begin]

    def sums(self, below: np.ndarray) -> np.ndarray:
        """By context: training count, tokens counted r times (r up to DISCOUNTED), and probability below of what was seen."""
        n, c = len(self.contexts), self.count
        columns = [c, *(np.where(c == r, r, 0) for r in range(1, DISCOUNTED + 1)), np.where(c > 0, below, 0.0)]
        return np.stack([np.bincount(self.context, weights=x, minlength=n) for x in columns], axis=1)


def discounts(stats: dict[str, int]) -> np.ndarray:
    """d_r for r up to DISCOUNTED by Good and Turing as Katz has them, 1 above. Where the counts of counts give no value
    between 0 and 1, half a count is taken off."""
    n = [0, *(stats.get(f"n{i}", 0) for i in range(1, DISCOUNTED + 2))]
    out = np.ones(DISCOUNTED + 2)
    rest = (DISCOUNTED + 1) * n[-1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


class Words:
    """Discounted probabilities of words; what is left is the probability of the unknown word."""

    def __init__(self, stats: dict[str, int]):
        self.discount, self.total = discounts(stats), stats.get("tokens", 0)
        left = sum((1 - self.discount[r]) * r * stats.get(f"n{r}", 0) for r in range(1, DISCOUNTED + 1))
        if not left:  # nothing was discounted: one more token stands for the unknown
            left, self.total = 1.0, self.total + 1
        self.unknown = left / self.total

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        kept = self.discount[np.minimum(counts, DISCOUNTED + 1)] * counts / self.total
        return np.where(counts > 0, kept, self.unknown)


def _bigram_stats(sent, words: Words, hot: set[int]):
    own = Owned(sent)
    yield from _count_stats(own.count)
    sums = own.sums(words(own.word_count))
    for i in np.flatnonzero(np.isin(own.contexts, np.array(sorted(hot), np.uint64))):
        yield int(own.contexts[i]), sums[i]


def log_probabilities(own: Owned, words: Words, discount: np.ndarray, hot: dict[int, np.ndarray]) -> np.ndarray:
    """log10 P(word | context) of each distinct bigram: the discounted share where it was seen in training, else the context's
    weight times the word's own probability; the weight makes the probabilities of a context sum to 1. A context never
    seen leaves the word's own probability."""
    below = words(own.word_count)
    sums = own.sums(below)
    for i, h in enumerate(own.contexts.tolist()) if hot else ():
        if h in hot:
            sums[i] = hot[h]
    total = sums[:, 0]
    small = sums[:, 1 : DISCOUNTED + 1]
    total = total + ((total > 0) & (small.sum(axis=1) == 0))  # nothing discounted: one more token stands for the rest
    with np.errstate(divide="ignore", invalid="ignore"):
        left = (total - sums[:, 0] + (small * (1 - discount[1 : DISCOUNTED + 1])).sum(axis=1)) / total
        weight = np.where(total > 0, left / (1 - np.minimum(sums[:, -1], 1 - 1e-12)), 1.0)
        seen = discount[np.minimum(own.count, DISCOUNTED + 1)] * own.count / total[own.context]
        return np.log10(np.where(own.count > 0, seen, weight[own.context] * below))


def _scored(sent, words: Words, discount: np.ndarray, hot: dict[int, np.ndarray]):
    """Sums of log probabilities by document, back to the chunks."""
    own = Owned(sent)
    logs = log_probabilities(own, words, discount, hot)
    at = 0
    for chunk, n, (_, runs, _, _, _, lengths, docs) in own.sent:
        rows = own.row[at : at + int(runs.astype(np.int64).sum())]
        at += len(rows)
        yield chunk, np.bincount(docs, weights=np.repeat(logs[rows], lengths), minlength=n).tobytes()


def _finished(pair, parts: int, stats: dict[str, int]):
    (blobs, answers), sums = pair
    chunk = Chunk(b for _, b in blobs)
    known = _known(chunk, answers, parts)[chunk.tokens]
    n, v = stats.get("tokens", 0), stats.get("types", 0)
    base = np.bincount(chunk.doc, weights=np.log10((known + 0.1) / (n + 0.1 * (v + 1))), minlength=len(chunk.rows))
    found = np.bincount(chunk.doc, weights=known > 0, minlength=len(chunk.rows))
    score = np.zeros(len(chunk.rows))
    for part in sorted(bytes(s) for _, s in sums):  # one order of adding, whatever arrives first
        score += np.frombuffer(part)
    for i, (doc, held) in enumerate(chunk.rows):
        yield doc, held, int(chunk.sizes[i]), int(found[i]), n, float(base[i]), float(score[i])


def _chunks(documents: DataFrame, id_col: str, text_col: str, parts: int) -> RDD:
    """Documents dealt in turn into ``parts`` chunks, compressed: chunk, (place, blob). The place is that of the rows in the
    input, by partition and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                rows = list(zip(*(c.to_pylist() for c in some.columns), strict=True))
                dealt: dict[int, list] = {}
                for row in rows:
                    dealt.setdefault(at % parts, []).append(row)
                    at += 1
                columns = [pa.array(list(dealt), pa.int32()), pa.array([place] * len(dealt), pa.int64()), pa.array([bytes(_packed(d, 9)) for d in dealt.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "rows"])
                place += 1

    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col, FOLDS).alias("held"), F.col(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, "chunk int, place long, rows binary").rdd.map(lambda r: (r[0], (r[1], r[2])))


def _dealt(rdd: RDD, parts: int) -> RDD:
    return rdd.partitionBy(parts, int)


def _beside(left: RDD, right: RDD) -> RDD:
    """Partitions with one number side by side: nothing moves."""
    return left.glom().zip(right.glom())


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words are runs without ASCII white space, A-Z in small letters; every text has one end after its last word, so a null or
    empty text has one token. The model learns from documents that are not held out (crc32 of the id as text, a null id
    being the empty text). ``score`` is the log10 probability of the whole text: bigrams by Katz, from them to
    words, from them to the unknown word. Repeated rows count as they stand; without training documents all words are
    unknown. An empty table gives an empty table. Other columns are not read.

    Words and bigrams are known by hashes of 64 and 48 bits (the latter within a context). Texts move once, compressed, into
    chunks. Each chunk asks the owners of its words for their counts; then it sends its distinct bigrams, with the documents
    that have them, to the owners of their contexts, which hold the partitioned table of counts, weigh the contexts and send
    sums by document back. Both tables are read twice from one shuffle (counts of counts, then answers); a lost
    executor's part is made again from its inputs, whose partitions must then give their rows in the same order, as files do.
    Shuffled blocks may arrive in any order. The driver holds counts of counts and fewer than ``HOT`` hot words.
    """
    spark = documents.sparkSession
    size = documents.select(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    parts = max(partitions(spark) * 3 // 2, size // CHUNK_BYTES + 1)
    add = lambda a, b: a + b
    chunks = _dealt(_chunks(documents, id_col, text_col, parts), parts)
    requests = _dealt(chunks.mapPartitionsWithIndex(lambda i, it: _word_counts(i, it, parts)), parts)
    stats = dict(requests.mapPartitions(_word_stats).reduceByKey(add, 8).collect())
    words = Words(stats)
    above = stats.get("tokens", 0) / HOT
    hot = {h for h, _ in requests.mapPartitions(lambda it: _hot_words(it, above)).collect()} | {int(START)}
    asked = _beside(chunks, _dealt(requests.mapPartitions(_answers), parts))
    bigrams = _dealt(asked.mapPartitionsWithIndex(lambda i, it: (x for pair in it for x in _bigrams(i, pair, parts, hot))), parts)
    # Counts of counts are keyed by text, sums of hot contexts by hash: fewer than HOT + 10 keys.
    told = dict(bigrams.mapPartitions(lambda it: _bigram_stats(it, words, hot)).reduceByKey(add, 8).collect())
    discount = discounts({k: v for k, v in told.items() if isinstance(k, str)})
    sums = {k: v for k, v in told.items() if not isinstance(k, str)}
    scores = _dealt(bigrams.mapPartitions(lambda it: _scored(it, words, discount, sums)), parts)
    rows = _beside(asked, scores).mapPartitions(lambda it: (row for (pairs, back) in it for pair in pairs for row in _finished((pair, back), parts, stats)))
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType)])
    for name, kind in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())):
        schema = schema.add(name, kind)
    return spark.createDataFrame(rows, schema, verifySchema=False)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
