"""Benchmark passages in documents, by a positional inverted index of the documents. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinpanel.llm.common import lookup, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, in texts whose A-Z are small letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same in texts as they are.
BETWEEN_ANY = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Words of a window; words of it that must stand near their places for a proximity match; and how far off these may be.
WINDOW, NEAR, SLACK = 10, 8, 2


def words(text_col: str) -> Column:
    """All words of a text in order; none for null."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BETWEEN), "")


def _text_key(text_col: str) -> list[Column]:
    """Two hashes that together tell texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


DOC = ["t1", "t2"]


@dataclass
class Index:
    """Written tables. ``postings``: ``t1, t2`` (the text), ``term, pos`` for every place of a benchmark word; ``terms``: ``item, ipos,
    term, n`` (words of the item) and ``df`` (places of the term in the documents); ``items``: ``item, item_id``."""

    postings: DataFrame
    terms: DataFrame
    items: DataFrame


def build_index(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text") -> Index:
    """Places of the benchmark's words in all documents, and the benchmark's words with their numbers of places.

    The texts are split once; a word becomes a posting if a benchmark text has it. Postings are known by their text: rows with
    equal texts have the same ones. Nothing is broadcast but what Spark itself finds small enough.
    """
    items = stored(benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(bench_col).alias("words"), F.monotonically_increasing_id().alias("item")))
    said = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "word"))
    vocabulary = stored(said.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    tokens = documents.select(*_text_key(text_col), F.posexplode(words(text_col)).alias("pos", "word"))
    postings = stored(tokens.join(vocabulary, "word").select(*DOC, "term", "pos"))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = said.join(vocabulary, "word").join(counts, "term", "left").select("item", "ipos", "term", "n", F.coalesce("df", F.lit(0)).alias("df"))
    return Index(postings, stored(terms), items.select("item", "item_id"))


def matches(index: Index, window: int = WINDOW, near: int = NEAR, slack: int = SLACK) -> DataFrame:
    """``t1, t2, item, first, last, exact``: document words that a window of an item covers, by its first and last place.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. ``exact``: all its words stand there one after
    the other. Otherwise a proximity match: at least ``near`` in ``window`` of its words, the two rarest among them, stand where they
    would after a shift by ``slack`` words at most against one of these two.

    Rarity is the number of places in the documents; words that no document has are passed over. Each window asks for its two
    rarest words (a window of one word for that). The lists of their places, less the words' places in the item, give alignments of
    text and item, and are intersected by text: what is left are few texts, whose other lists are then looked up by text, term
    and place, up to a window's length from the place that was found. At last places in the item are counted over each window.
    """
    at = Window.partitionBy("item").orderBy("ipos")
    size = F.least(F.col("n"), F.lit(window))
    enough = F.ceil(size * near / window)
    ahead = at.rowsBetween(0, window - 1)
    known = F.sort_array(F.collect_list(F.when(F.col("df") > 0, F.struct("df", "ipos", "term"))).over(ahead))
    asked = index.terms.withColumn("rare", known).filter((F.col("ipos") <= F.col("n") - size) & (F.size("rare") >= enough))
    first, second = F.element_at("rare", 1), F.get("rare", F.lit(1))
    pairs = asked.select("item", "n", first.alias("x"), F.coalesce(second, first).alias("y")).distinct().withColumn("pair", F.monotonically_increasing_id())
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), "x.ipos", "x.term"), F.struct(F.lit(1).alias("side"), "y.ipos", "y.term")))
    asked = stored(pairs.select("item", "n", "pair", sides.alias("s")).select("item", "n", "pair", "s.*"))
    hits = index.postings.join(asked, "term").select(*DOC, "pair", "item", "n", "side", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos").distinct()
    around = Window.partitionBy(*DOC, "pair").orderBy("shift").rangeBetween(-slack, slack)
    both = F.min("side").over(around) < F.max("side").over(around)
    hits = stored(hits.withColumn("both", both).filter("both").select(*DOC, "item", "n", "shift", "ipos").distinct())
    # Places that are looked up: up to a window's length from the word found, on its alignment and up to slack beside it.
    reach = F.sequence(F.greatest(F.col("ipos") - window + 1, F.lit(0)), F.least(F.col("ipos") + window - 1, F.col("n") - 1))
    probes = hits.select(*DOC, "item", "shift", F.explode(reach).alias("ipos")).distinct().join(index.terms.select("item", "ipos", "term", "n"), ["item", "ipos"])
    place = F.col("shift") + F.col("ipos")
    probes = probes.withColumn("pos", F.explode(F.sequence(place - slack, place + slack)))
    texts = stored(hits.select(*DOC).distinct())
    there = index.postings.join(texts, DOC, "left_semi").distinct()
    votes = stored(probes.join(there, [*DOC, "term", "pos"]).select(*DOC, "item", "n", "shift", "ipos", "pos"))
    along = Window.partitionBy(*DOC, "item", "shift").orderBy("ipos").rangeBetween(0, window - 1)
    starts = F.col("ipos") <= F.col("n") - size
    exact = votes.filter(F.col("pos") == place).withColumn("held", F.count("*").over(along)).filter((F.col("held") == size) & starts)
    exact = exact.select(*DOC, "item", F.col("pos").alias("first"), (F.col("pos") + size - 1).alias("last"), F.lit(True).alias("exact"))
    joined = votes.groupBy(*DOC, "item", "n", "shift", "ipos").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    close = joined.withColumns({"held": F.count("*").over(along), "first": F.min("low").over(along), "last": F.max("high").over(along)})
    close = close.filter(F.col("held") >= enough).select(*DOC, "item", "first", "last", F.lit(False).alias("exact"))
    return exact.unionByName(close)


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", window: int = WINDOW, near: int = NEAR, slack: int = SLACK) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    Words are runs of ASCII letters and digits and of any other than ASCII characters, A-Z in small letters. ``n_hit``: words inside an
    exact occurrence of a window; ``n_items``: items with such a window; ``items_sha256``: SHA-256 of their ids, sorted as text and
    joined by commas; ``contaminated``: any hit. ``n_near``: items that only match nearly (see ``matches``).
    Null and empty texts have no words. Rows with one item id are one item; null ids count together, as an empty text. Items without
    words have no window. Repeated documents get a row each. Other columns are not read. An empty table of documents
    gives an empty table; without a benchmark nothing is hit.

    Results are worked out once a text and joined to the rows; those of texts with many copies are broadcast, fewer than a
    thousand (``lookup``).
    """
    index = build_index(documents, benchmark, text_col, item_col, bench_col)
    found = stored(matches(index, window, near, slack).join(index.items, "item").select(*DOC, F.coalesce("item_id", F.lit("")).alias("item_id"), "first", "last", "exact").distinct())
    before = Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("first", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)
    covered = found.filter("exact").select(*DOC, "first", "last").distinct().withColumn("new", F.greatest(F.col("last") - start + 1, F.lit(0)))
    hit = covered.groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    items = found.groupBy(*DOC, "item_id").agg(F.max("exact").alias("exact")).groupBy(*DOC).agg(
        F.count_if("exact").alias("n_items"), F.count_if(~F.col("exact")).alias("n_near"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))), ",").cast("binary"), 256).alias("items_sha256")
    )
    texts = stored(items.join(hit, DOC, "left"))
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BETWEEN_ANY), "")).cast("long")
    rows = stored(documents.select(F.col(id_col).alias("doc_id"), *_text_key(text_col), n_words.alias("n_words")))
    copies = rows.join(texts.select(*DOC), DOC, "left_semi").groupBy(*DOC).agg(F.count("*").alias("copies"))
    table = stored(texts.join(copies, DOC))
    out = lookup(rows, table, DOC, "copies", rows.count(), how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(T.LongType()).alias(c)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"))


def op13_contamination(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))


_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS item, coalesce(item_id::VARCHAR, '') AS item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
wins AS (SELECT DISTINCT item_id, w[s:s + least(len(w), {WINDOW}) - 1] AS win
         FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM wins),
places AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT r, s, k, item_id FROM (SELECT r, s, k, w[s:s + k - 1] AS win FROM places) JOIN wins USING (win)),
n_hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r),
post AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d),
df AS (SELECT word, count(*) AS n FROM post GROUP BY word),
said AS (SELECT item, word, ipos, len, coalesce(df.n, 0) AS n, least(len, {WINDOW}) AS size
         FROM (SELECT item, len(w) AS len, unnest(w) AS word, unnest(generate_series(1, len(w))) AS ipos FROM b) LEFT JOIN df USING (word)),
rare AS (SELECT item, list_sort(list({{'n': n, 'ipos': ipos, 'word': word}}) FILTER (WHERE n > 0) OVER (PARTITION BY item ORDER BY ipos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) AS l,
                ipos, len, size FROM said),
pairs AS (SELECT DISTINCT item, l[1] AS x, coalesce(l[2], l[1]) AS y FROM rare WHERE ipos <= len - size + 1 AND len(l) >= ceil(size * {NEAR} / {WINDOW})),
both_ AS (SELECT DISTINCT r, item, px.pos - x.ipos AS sx, x.ipos AS ix, py.pos - y.ipos AS sy, y.ipos AS iy
          FROM pairs JOIN post px ON px.word = x.word JOIN post py USING (r) WHERE py.word = y.word AND abs(px.pos - x.ipos - (py.pos - y.ipos)) <= {SLACK}),
lines AS (SELECT r, item, sx AS shift, ix AS ipos FROM both_ UNION SELECT r, item, sy, iy FROM both_),
votes AS (SELECT DISTINCT l.r, l.item, l.shift, s.ipos, s.size, s.len
          FROM lines l JOIN said s ON s.item = l.item AND s.ipos BETWEEN l.ipos - {WINDOW - 1} AND l.ipos + {WINDOW - 1}
          JOIN post p ON p.r = l.r AND p.word = s.word AND p.pos BETWEEN s.ipos + l.shift - {SLACK} AND s.ipos + l.shift + {SLACK}),
near AS (SELECT DISTINCT r, item_id FROM (
           SELECT r, item, size, count(*) OVER (PARTITION BY r, item, shift ORDER BY ipos RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS held FROM votes
         ) JOIN b USING (item) WHERE held >= ceil(size * {NEAR} / {WINDOW})),
n_near AS (SELECT r, count(*) AS n FROM (FROM near EXCEPT SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated, coalesce(n_near.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r) LEFT JOIN n_near USING (r)
"""
