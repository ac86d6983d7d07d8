"""Operators over single texts: licenses, languages, pieces."""

from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

from kinpanel.llm import language, licenses, pieces
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def test_base_phrases_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, "CC BY cc by 4.0, All rights  reserved. General-Public-License cc by"), (-2, None)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    want = {}
    for doc, text in docs.collect():
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
        want[doc] = (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
    got = licenses.scan_licenses(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_rules_are_many_and_ordered():
    rules = licenses.rules()
    assert len(rules) > 200 and [r[3] for r in rules] == sorted((r[3] for r in rules), reverse=True)


def test_contained_and_weaker_detections_fall():
    keep = licenses.resolve([(0, 10, "weak", 10), (2, 6, "strong", 60), (2, 6, "same", 60), (3, 5, "inside", 60), (20, 30, "far", 5)])
    assert [k[2] for k in keep] == ["weak", "same", "far"]


def test_versions_and_terms(spark):
    texts = ["GNU Lesser General Public License v2.1 or later", "licensed under CC BY-NC-SA 4.0", "Apache License, Version 2.0", "no licence here"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["gpl,lgpl-2.1+", "cc-by,cc-by-nc-sa-4.0", "apache-2.0", ""]


def test_odd_rows(odd, none, clash):
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(clash).count() == len(ODD)
    model = language.fit(odd)
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert found[4, None] == found[5, ""] == found[8, "...!!! 123"] == ("und", 0.0)
    assert language.identify(none, language.fit(none)).count() == 0
    assert language.identify(odd, language.fit(none)).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert set(language.identify(clash, model).columns) == set(clash.columns)
    rows = pieces.encode(clash)
    assert rows.count() == len(ODD) and dict(rows.dtypes)["tokens"] == "array<int>"
    assert pieces.encode(none).count() == 0


def test_language_sample_is_bounded_and_holds_every_language(spark):
    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05}")
    rows = [("many", word(i)) for i in range(900)] + [("many", word(7))] * 500  # more than a third are copies
    for k in range(20):
        rows += [(f"copies{k:02}", "klmnopqrst"[k % 10] * 4 + "uv"[k // 10] * 3)] * 300
    rows += [("none", "123 456")] * 300
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").repartition(4), docs_per_lang=100)
    assert model["langs"] == [*(f"copies{k:02}" for k in range(20)), "many"]
    logs, column = model["logs"][0], model["langs"].index("many")
    seen = logs[:, column] > logs[:, column].min()
    assert seen.sum() == 100 and len(set(logs[seen, column].round(9))) == 1  # a copied text counts once
    scorer = language.Scorer(model)
    for lang, text in {r for r in rows if r[0].startswith("copies")}:
        assert scorer(text)[0] == lang


def test_language_is_right_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()))
    right = language.identify(docs.filter(language.held_out()), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    unseen = spark.createDataFrame([("ungsverkeitüber schenkeitung",), ("lesquement tionaireaux étion",)], "text string")
    assert [r.lang_pred for r in language.identify(unseen, model).collect()] == ["de", "fr"]


def test_fold_is_crc32(spark):
    got = spark.range(200).select("id", language.held_out("id")).collect()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got)


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Encoder(pieces.read_pieces(f.read()))


def _library(encoder):
    """The library's own search over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(pieces.MODEL, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    for piece, score in zip(model.pieces, encoder.pieces.scores, strict=True):
        if piece.type in (1, 4):
            piece.score = score
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_encoding_is_a_best_path(spark, encoder):
    """Equal to the library's ids, or (ties) to another path of the same score."""
    library = _library(encoder)
    score = encoder.pieces.scores
    same = 0
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if t]
    for text in texts:
        ours, theirs = encoder.encode(text).tolist(), library.encode(text)
        same += ours == theirs
        assert abs(sum(score[i] for i in ours if encoder.pieces.types[i] == 1) - sum(score[i] for i in theirs if encoder.pieces.types[i] == 1)) < 0.01
    assert same > 0.9 * len(texts)


def test_small_best_paths_equal_brute_force(encoder):
    table = {t: (s, i) for i, (t, s, k) in enumerate(zip(encoder.pieces.texts, encoder.pieces.scores, encoder.pieces.types, strict=True)) if k == 1}

    def best(run):
        if not run:
            return 0.0
        return max([table[run[:n]][0] + best(run[n:]) for n in range(1, len(run) + 1) if run[:n] in table] + [encoder.penalty + best(run[1:])])

    for word in ["▁hello", "▁wordings", "▁überx", "a一b\U0001f600", "▁▁▁x"]:
        import numpy as np

        ids = np.frombuffer(encoder.best(word), np.int32).tolist()
        got = sum(encoder.pieces.scores[i] for i in ids if encoder.pieces.types[i] == 1)
        unknown = [c for c in word if c not in table]
        assert abs(got + encoder.penalty * len(unknown) - best(word)) < 1e-9


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "  two  blanks \n\t end "), (-2, ""), (-3, "一\U0001f600 \u0000 mixed"), (-4, None), (-5, " ")], "doc_id long, text string")
    encoded = pieces.encode(docs.unionByName(extra))
    assert encoded.filter("not round_trip").count() == 0
    back = pieces.decode(encoded.select("doc_id", "text", "tokens"), to="again")
    assert back.filter("not (text <=> again)").count() == 0
    row = encoded.filter("doc_id = -4").first()
    assert row.tokens is None and row.n_tokens == 0 and row.round_trip is None


def test_space_sign_is_lost_and_reported(odd):
    assert [r.doc_id for r in pieces.encode(odd).filter("not round_trip").collect()] == [9]
