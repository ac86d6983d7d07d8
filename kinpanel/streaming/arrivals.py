"""Append new register files to a panel: each file is processed once, also after a failure.

The file source remembers the files it has seen in the checkpoint folder, and
every batch overwrites its own folder of the panel, so a batch that is run again
leaves no double rows.  Files that change in place are a matter for
``sources.manifest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinpanel.fixed_values import PANEL_DROPS, REGISTERS
from kinpanel.sources.registers import with_period
from kinpanel.sources.tables import write_panel


def arriving_register(spark: SparkSession, name: str, folder: str, layout: dict[str, str] | None = None, files_per_batch: int = 100) -> DataFrame:
    """Stream of a register's rows with the period of their file; columns a file lacks are null."""
    columns = layout or REGISTERS[name]
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)
    return with_period(rows).drop(*PANEL_DROPS.get(name, []))


def append_to_panel(rows: DataFrame, panel: str, checkpoint: str) -> StreamingQuery:
    """Process the files that have arrived so far, then stop; run again for later ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_panel(batch, f"{panel}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, panel: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(panel).drop("batch")
