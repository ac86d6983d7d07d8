"""A training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stage by stage: documents without a recognised language go; boilerplate lines of a source go; of near-duplicate documents the
one with the smallest id stays; documents are repeated or left out so that sources meet their target weights; the rest is
encoded into piece ids. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinpanel.llm.common import lookup, shared_folder, stored, text_hash
from kinpanel.llm.jaccard import near_groups
from kinpanel.llm.language import fit, held_out, identify
from kinpanel.llm.lines import dedup_lines
from kinpanel.llm.mixing import mix
from kinpanel.llm.pieces import encode

#: A language is recognised when its posterior reaches this.
SURE = 0.5


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, hold no letter, or fit no learned language better than all others together."""
    found = identify(docs, fit(docs.filter(~held_out())))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of a source out of the texts; ``n_chars`` follows the text. No document goes.

    Copies are pages of their own: a text whose copies are more than a tenth of a source (and at least five) is boilerplate as a
    whole. All copies stay as empty rows, which the next stage links with nothing, so none of that text of the source goes on."""
    out = dedup_lines(docs, "source", "text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays. Where rows repeat an id, each goes by its own
    text: of the rows of one id in one group the least in order of the columns stays, rows in different groups all stay.
    Texts without words are in one group only where they are equal, null counting as empty. Rows without an id cannot be
    told apart by it and stay."""
    groups = near_groups(docs.select("doc_id", "text"), by_text=True).filter("doc_id is not null")
    stays = F.max(F.col("doc_id") == F.col("component_id")).alias("__stays")
    texts = stored(groups.groupBy("doc_id", F.col("text_key").alias("__text"), F.col("component").alias("__group")).agg(stays, F.count("*").alias("__rows")))
    first = texts.filter("__stays")
    shared = stored(first.groupBy("doc_id", "__group").agg(F.count("*").alias("__texts"), F.sum("__rows").alias("__n")).filter("__n > 1").drop("__n"))
    repeated = lookup(first, shared, ["doc_id", "__group"], "__texts", texts.count()).select(*texts.columns)
    marked = stored(texts.filter("not __stays").unionByName(repeated))
    rows, key, total = docs.withColumn("__text", text_hash("text")), ["doc_id", "__text"], docs.count()
    rest = lookup(rows, marked, key, "__rows", total, how="left").filter("__stays is null").select(*docs.columns)
    again = marked.filter("__stays")
    if again.limit(1).count():
        least = lookup(rows, again, key, "__rows", total).groupBy("doc_id", "__group").agg(F.min(F.struct(*docs.columns)).alias("__row"))
        rest = rest.unionByName(least.select("__row.*"))
    return rest


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents, or leaves them out, so that sources meet their target weights."""
    return mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text of the mix."""
    return encode(docs).select("doc_id", "lang", "source", "tokens", "n_tokens", "round_trip")


STAGES = [
    ("language", recognise_language),
    ("lines", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: The classifier, the balancing and the piece search are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
