"""Code dictionaries and ICD texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{"code": "label", ...}`` as rows of ``code`` and ``label``."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,string>"))
    return text.select(entries.alias("code", "label"))


def read_education_levels(spark: SparkSession, json_path: str, table_path: str | None = None) -> DataFrame:
    """Distinct ``(HFAUDD, EDU_LVL)``; with ``table_path`` written there once and read from there."""
    levels = read_json_dictionary(spark, json_path).select(F.col("code").alias("HFAUDD"), F.col("label").alias("EDU_LVL")).distinct()
    if table_path is None:
        return levels
    # "ignore" leaves an existing table as it is.
    levels.write.mode("ignore").parquet(table_path)
    return spark.read.parquet(table_path)


def read_icd_texts(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: ICD-10 code and description."""
    return spark.read.csv(path, header=True, schema="icd10 string, description string")
