"""Language ID: known words first, then progressively shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the classifier: different labelled texts read for it a language, words and n-grams kept.
DOCS_PER_LANG = 2000
WORDS_PER_LANG = 50_000
GRAMS_PER_LANG = 20_000
MOST_LANGS = 400
ORDERS = (4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 200_000
#: Rows of an Arrow batch that are worked on at a time.
_ROWS = 250


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(_WORD.findall(text.lower())).items():
                counts[lang, 0, word] += n
                padded = f"\x02{word}\x03"
                for size in ORDERS:
                    for i in range(len(padded) - size + 1):
                        counts[lang, size, padded[i : i + size]] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "size", "gram", "n"],
        )


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> dict:
    """Word and n-gram log frequencies of each language, from a bounded, repeatable sample of the labelled rows.

    Rows without text or language are left out. The sample holds, of the different texts of a language, the ``docs_per_lang``
    with the least hashes (all where there are fewer), each once however often it is repeated. A language whose chosen texts
    hold no letter is not learned. More than ``MOST_LANGS`` languages are an error, not a choice of some of them. The model
    keeps the most frequent words and n-grams, so it has a size bound:
    {langs: [...], tables: {size: {gram: row}}, logs: {size: matrix}} where size 0 stands for words.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = dict(rows.select("lang", "h").distinct().groupBy("lang").count().limit(MOST_LANGS + 1).collect())
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return {"langs": [], "tables": {}, "logs": {}}
    # Hashes are even over 64 bits: below this cut are twice the texts wanted and some more, of which the least are taken.
    cuts = {k: int(min((2 * docs_per_lang + 100) / n, 1.0) * (2**64 - 2**12)) - 2**63 if n > docs_per_lang else 2**63 - 1 for k, n in sizes.items()}
    cut = F.element_at(F.create_map(*[F.lit(x) for k, c in sorted(cuts.items()) for x in (k, c)]).cast("map<string,long>"), F.col("lang"))
    least = Window.partitionBy("lang").orderBy("h")
    keys = rows.select("lang", "h").filter(F.col("h") <= cut).distinct().withColumn("k", F.row_number().over(least)).filter(F.col("k") <= docs_per_lang)
    last = F.create_map(*[F.lit(x) for k, h in sorted(keys.groupBy("lang").agg(F.max("h")).collect()) for x in (k, h)]).cast("map<string,long>")
    chosen = rows.filter(F.col("h") <= F.element_at(last, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    counted = chosen.select("lang", "text").mapInArrow(_counted, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= F.when(F.col("size") == 0, WORDS_PER_LANG).otherwise(GRAMS_PER_LANG))
    found = sorted((r["size"], r["gram"], r["lang"], r["n"]) for r in top.select("lang", "size", "gram", "n").toLocalIterator())
    langs = sorted({f[2] for f in found})
    tables, logs = {}, {}
    for size in (0, *ORDERS):
        mine = [f for f in found if f[0] == size]
        table = {g: i for i, g in enumerate(dict.fromkeys(f[1] for f in mine))}
        counts = np.zeros((len(table), len(langs)))
        for _, gram, lang, n in mine:
            counts[table[gram], langs.index(lang)] = n
        tables[size], logs[size] = table, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(len(table), 1)))
    return {"langs": langs, "tables": tables, "logs": logs}


def backed_off(word: str, model: dict) -> np.ndarray:
    """Log frequencies of a word by language: its own, else the mean over its longest n-grams that are known."""
    row = model["tables"][0].get(word)
    if row is not None:
        return model["logs"][0][row]
    padded = f"\x02{word}\x03"
    for size in ORDERS:
        table = model["tables"][size]
        rows = [r for i in range(len(padded) - size + 1) if (r := table.get(padded[i : i + size])) is not None]
        if rows:
            return model["logs"][size][rows].mean(axis=0)
    return np.zeros(len(model["langs"]))


class Scorer:
    """Sums word scores over whole texts; remembers the scores of words seen, up to a bound."""

    def __init__(self, model: dict):
        self.model, self.rows = model, {}
        self.matrix = np.zeros((1024, max(len(model["langs"]), 1)))

    def _row(self, word: str) -> int:
        if len(self.rows) == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[len(self.rows)] = backed_off(word, self.model)
        self.rows[word] = row = len(self.rows)
        return row

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text and self.model["langs"] else []
        if not words:
            return "und", 0.0
        if len(self.rows) > _REMEMBERED:
            self.rows = {}
        get = self.rows.get
        at = [r if (r := get(w)) is not None else self._row(w) for w in words]
        total = self.matrix[at].sum(axis=0)
        best = int(total.argmax())
        return self.model["langs"][best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def identify(documents: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``: the language with the largest sum of log frequencies over all words of
    the whole text and its posterior among the learned languages. ``und`` and 0 where the text is null, empty or has no
    letter, or nothing was learned. Ties go to the language first in order. Every row gives one row, repeated or not;
    other columns are kept, input columns of those two names are replaced. Only ``text_col`` is read for the prediction.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded, see fit()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer(t) for i in range(0, len(batch), _ROWS) for t in batch.slice(i, _ROWS).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    predict = F.arrow_udf(run, "lang_pred string, score double")
    rest = [c for c in documents.columns if c not in ("lang_pred", "score")]
    return documents.select(*rest, predict(F.col(text_col)).alias("__p")).select(*rest, "__p.lang_pred", "__p.score")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(documents.filter(~held_out()))
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
