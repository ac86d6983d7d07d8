"""Benchmark passages in documents, against plain loops over words."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from kinpanel.llm.contamination import CONTAMINATION_SQL, build_index, contamination, matches, op13_contamination

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"
NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(items):
    out = set()
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            out.add((item or "", tuple(w[s : s + 10])))
    return out


def plain(docs, items):
    wins, out = windows(items), []
    for doc, text in docs:
        w = split(text)
        hit, names = set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == list(win):
                    hit.update(range(s, s + len(win)))
                    names.add(item)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the the the of of a b c d Élan naïve x1 ß 42 zz".split() + [f"w{rng.randrange(400)}"] * 6)
    text = lambda n: rng.choice([" ", "  ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(str(i), text(rng.randrange(3, 60))) for i in range(30)]
    items += [("the", "The"), ("run", "the " * 15), ("null", None), (None, text(12)), (None, text(8)), ("empty", " ... "), ("9", items[8][1]), ("10", items[8][1].upper()), ("0", items[0][1])]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(60)]
    for i in range(60, 140):
        w = split(rng.choice(items)[1])
        a = rng.randrange(len(w)) if w else 0
        docs.append((i, " ".join([text(rng.randrange(0, 20)), *w[a : a + rng.randrange(5, 40)], text(rng.randrange(0, 9)), *w])))
    docs += [docs[70]] * 40 + [(None, docs[71][1]), (None, None), (1, None), (2, ""), (3, "THE " * 500), (4, "the")]
    return docs, items


@pytest.mark.parametrize("seed", [1])
def test_against_plain_loops_and_sql(spark, seed):
    docs, items = made(seed)
    d, b = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    out = contamination(d, b)
    assert out.columns == [*NAMES, "n_near"]
    out = out.cache()
    assert found(out) == plain(docs, items)
    con = duckdb.connect()
    con.register("d", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("b", pd.DataFrame(items, columns=["item_id", "text"]))
    con.execute("create view documents as select * from d; create view benchmark as select * from b")
    rows = sorted(con.execute(CONTAMINATION_SQL).fetchall(), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == rows and sum(r[-1] for r in rows) > 5


def test_broadcast_or_not(spark):
    """The same rows when Spark may broadcast nothing by itself."""
    docs, items = made(3)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert found(contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == plain(docs, items)
    finally:
        spark.conf.set(key, before)


def test_near_passages(spark):
    w = [f"word{i}" for i in range(30)]
    swapped = w[:12] + ["other"] + w[13:]
    docs = [
        (1, " ".join(w)),
        (2, " ".join(w[:5] + ["new"] + w[5:10])),  # ten words with one put in
        (3, " ".join(w[:4] + ["p"] + w[5:8] + ["q"] + w[9:11])),  # two of ten replaced in every window
        (4, " ".join(w[::-1])),
        (5, " ".join(swapped)),
        (6, " ".join(w[:5] + ["new"] * 40 + w[5:10])),
        (7, "word4 word8 " * 9),  # so these two are not the rarest
    ]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("i", " ".join(w))], ITEMS)
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near"]) for r in contamination(d, b).collect()}
    assert rows == {1: (30, 1, 0), 2: (0, 0, 1), 3: (0, 0, 1), 4: (0, 0, 0), 5: (29, 1, 0), 6: (0, 0, 0), 7: (0, 0, 0)}
    spans = matches(build_index(d, b)).filter("not exact").join(d.selectExpr("doc_id", "xxhash64(text) as t1"), "t1")
    assert {(r["doc_id"], r["first"], r["last"]) for r in spans.filter("doc_id = 2").collect()} >= {(2, 0, 10)}


def test_edges(spark, odd, none, clash, odd_path):
    items = spark.createDataFrame([("a", "quick brown fox"), ("b", "one two")], ITEMS)
    empty = spark.createDataFrame([], ITEMS)
    assert contamination(none, items).collect() == []
    assert {r["contaminated"] for r in contamination(odd, empty).collect()} == {False}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(contamination(odd, items)) == plain(rows, [("a", "quick brown fox"), ("b", "one two")])
    names = {n: "x" for n in ("t1", "t2", "term", "pos", "item", "words", "word", "shift")}
    wide = clash.selectExpr("*", *[f"'{v}' as {k}" for k, v in names.items()])
    assert found(contamination(wide, items.selectExpr("*", "'x' as words", "'y' as item"))) == found(contamination(odd, items))
    numbers = spark.createDataFrame([(10, "one two"), (9, "one two"), (9, "one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(odd, numbers).collect()}[7]
    assert (got["n_items"], got["items_sha256"]) == (2, hashlib.sha256(b"10,9").hexdigest())


def test_no_python_in_the_plan(spark):
    out = op13_contamination(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan)
