from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

#: Rows that every operator over texts must survive: nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
    (2, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
    (3, "the  quick\tbrown fox jumps over the lazy dog", "en", None, 43),
    (None, "the quick brown fox jumps over the lazy dog", None, "a", None),
    (None, None, None, None, None),
    (4, None, "en", "a", None),
    (5, "", "en", "a", 0),
    (6, " \n\t ", "de", "a", 4),
    (7, "one two", "en", "c", 7),
    (8, "...!!! 123", None, "c", 10),
    (9, "der die das und über ähnlich groß ▁ \U0001f600", "de", "c", 30),
    (10, " ".join(f"w{i % 977}x{i}" for i in range(60_000)), "de", "a", 500_000),
    (11, "a" * 3000, "de", "a", 3000),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def odd_path(spark, tmp_path_factory):
    """The odd rows as a table on disk, in three files."""
    folder = tmp_path_factory.mktemp("odd")
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(ODD, DOCS).repartition(3).write.parquet(path)
    return str(folder)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns under the names that operators use for their own."""
    from pyspark.sql import functions as F

    names = ["n_lines", "lines", "pages", "host_key", "lang_pred", "score", "tokens", "n_tokens", "size", "taken", "copies", "keep_id", "component_id", "kept", "key", "rate", "skey", "docs"]
    return odd.withColumns({n: F.lit("x") for n in names})
