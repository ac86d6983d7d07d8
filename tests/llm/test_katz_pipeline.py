"""Katz scores against a plain model; the pipeline stage by stage; registration."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinpanel.llm import katz
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


class Plain:
    """The same model in dictionaries."""

    def __init__(self, sequences):
        self.words, self.pairs = Counter(), Counter()
        for s in sequences:
            self.words.update(s[1:])
            self.pairs.update(zip(s[:-1], s[1:], strict=True))
        self.d1, self.d2 = (katz.discounts({f"n{r}": Counter(c.values())[r] for r in range(1, 7)}) for c in (self.words, self.pairs))
        self.n = sum(self.words.values())
        left = sum(c - self._kept(self.d1, c) for c in self.words.values())
        self.total = self.n if left else self.n + 1
        self.unknown = (left or 1.0) / self.total
        self.context, self.left, self.below, small = Counter(), defaultdict(float), defaultdict(float), set()
        for (h, w), c in self.pairs.items():
            self.context[h] += c
            self.below[h] += self.word(w)
            if c <= katz.DISCOUNTED:
                small.add(h)
        for h in self.context:
            self.left[h] = float(h not in small)
            self.context[h] += h not in small
        for (h, _), c in self.pairs.items():
            self.left[h] += c - self._kept(self.d2, c)

    @staticmethod
    def _kept(d, c):
        return d[min(c, katz.DISCOUNTED + 1)] * c

    def word(self, w):
        return self._kept(self.d1, self.words[w]) / self.total if self.words[w] else self.unknown

    def __call__(self, h, w):
        if self.pairs[h, w]:
            return self._kept(self.d2, self.pairs[h, w]) / self.context[h]
        weight = self.left[h] / self.context[h] / (1 - self.below[h]) if self.context[h] else 1.0
        return weight * self.word(w)


def _sequence(text):
    return ["<s>", *(text or "").encode().lower().split(), "</s>"]


def _held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 10 == 0


def _check(rows, got):
    plain = Plain([_sequence(t) for d, t in rows if not _held(d)])
    v = len(plain.words)
    want = Counter()
    for doc, text in rows:
        s = _sequence(text)
        score = sum(math.log10(plain(h, w)) for h, w in zip(s[:-1], s[1:], strict=True))
        base = sum(math.log10((plain.words[w] + 0.1) / (plain.n + 0.1 * (v + 1))) for w in s[1:])
        want[doc, _held(doc), len(s) - 1, sum(plain.words[w] > 0 for w in s[1:]), plain.n, round(base, 4), round(score, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    return plain


def test_scores_equal_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = katz.score_documents(docs).collect()
    plain = _check([(r.doc_id, r.text) for r in docs.collect()], got)
    # Every context's probabilities, with one unknown word, sum to one.
    for h in ["<s>", b"the", b"of", b"never seen"]:
        assert abs(sum(plain(h, w) for w in [*plain.words, "unknown"]) - 1) < 1e-9
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows(odd, none, clash):
    _check([r[:2] for r in ODD], katz.score_documents(odd).collect())
    assert katz.score_documents(none).count() == 0 and katz.score_documents(clash).count() == len(ODD)


def test_scores_do_not_hang_on_arrival_order(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % (7 + i % 50)}" for j in range(1, 4 + i % 17))) for i in range(600)]
    dealt = katz._dealt

    def in_any_order(rdd, parts):
        def mixed(items):
            items = list(items)
            random.SystemRandom().shuffle(items)  # another order at each reading
            return iter(items)

        return dealt(rdd, parts).mapPartitions(mixed)

    monkeypatch.setattr(katz, "_dealt", in_any_order)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    _check(rows, katz.score_documents(docs).collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in katz.score_documents(docs).collect()) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_discounts_stay_between_zero_and_one():
    for n in ([5, 4, 3, 2, 1, 1], [0] * 6, [1, 0, 0, 0, 0, 9], [1000, 300, 120, 70, 40, 30]):
        d = katz.discounts({f"n{i + 1}": x for i, x in enumerate(n)})
        assert np.all((d[1:-1] > 0) & (d[1:-1] < 1)) and d[-1] == 1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(-1, "12 34 !!", None, "src0", 8), (-2, None, None, None, None)], docs.schema)
    folder, counts = str(tmp_path), {}
    docs.unionByName(junk).write.parquet(f"{folder}/in")
    docs = spark.read.parquet(f"{folder}/in")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        counts[name] = docs.count()
        if name == "language":
            assert counts[name] == before.count() - 2
        if name == "lines":
            assert counts[name] == before.count()
        if name == "near_copies":
            from tests.llm.test_dedup import _near

            want = {d for d, _, c in _near([(r.doc_id, r.text) for r in before.collect()]) if d == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.filter("not round_trip").count() == 0 and counts["mix"] == counts["pieces"] > 0


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_survive_odd_tables(spark, odd, tmp_path, rows):
    docs = odd.limit(0) if not rows else odd
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
    assert docs.count() >= 0


def test_text_of_many_copies_is_boilerplate(spark):
    copied = "first line of the copy\n\nlast line of the copy"
    rows = [(i, copied, "en", "a", 99) for i in range(6)] + [(i, f"own text number {i} of this page", "en", "a", 99) for i in range(6, 18)] + [(20, copied, "en", "b", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_boilerplate(spark, docs, ""), "").collect()
    left = {r.doc_id: (r.text, r.n_chars) for r in out}
    assert [left[i] for i in range(6)] == [("", 0)] * 6  # the six copies stay, empty
    assert left[20] == (copied, 99) and len([i for i in left if 6 <= i < 18 and left[i][0]]) >= 1


def test_near_copies_keep_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (5, "other text of its own"), (None, text)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 5), (True, 0)]


def test_near_copies_tell_rows_of_one_id_apart(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "wv")
    near = one + " more"
    rows = [(1, one), (1, two), (1, near), (2, near), (2, "a text of its own kind"), (3, ""), (3, ""), (3, "words of three"), (None, two), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    for parts in (1, 5):
        kept = corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), "").collect()
        want = [(1, one), (1, two), (2, "a text of its own kind"), (3, ""), (3, "words of three"), (None, two), (None, two)]
        assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert F.lit(1) is not None


@pytest.mark.parametrize("high", [50, 1 << 62])
def test_codes_are_sorted_with_their_places(high):
    """As one number where code and place fit, else by a stable sort: the same order."""
    code = np.random.default_rng(3).integers(0, 40, 500) + (high - 50)
    got, place = katz._ordered(code)
    assert np.array_equal(place, np.argsort(code, kind="stable")) and np.array_equal(got, code[place])
    assert [len(x) for x in katz._ordered(code[:0])] == [0, 0]


def test_bigrams_of_a_chunk():
    rows = [(1, False, b"a b a b"), (2, True, b"a b c"), (3, False, None), (4, False, b"c a b")]
    chunk = katz.Chunk([(0, katz._packed(rows))])
    want = defaultdict(list)
    for i, (_, _, body) in enumerate(rows):
        words = [None, *(body or b"").split(), b""]
        for pair in zip(words, words[1:], strict=False):
            want[pair].append(i)
    names = [b"a", b"b", b"c", b"", None]
    context, word, seen, places, docs = chunk.bigrams()
    ends = np.cumsum(places)
    got = {(names[h], names[w]): (n, docs[e - k : e].tolist()) for h, w, n, k, e in zip(context, word, seen, places, ends, strict=True)}
    assert got == {pair: (sum(i != 1 for i in at), at) for pair, at in want.items()}
