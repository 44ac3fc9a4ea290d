"""New batch rows and input files as they appear."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.batch_table import read_batches, store_upsert
from inkwell.operators.tracking import detected_batches


def upsert_stream(
    updates: DataFrame, table_path: str, order: list[str], checkpoint: str, **trigger: Any
) -> StreamingQuery:
    """Upsert a stream of batch rows into the stored table.

    A micro-batch adds its own rows as one segment. An epoch that is in the table
    is not added again, so a restart after a lost driver is safe. Fold segments
    with ``compact_batches`` from time to time, as a job of its own.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        store_upsert(batch, table_path, order, checkpoint, epoch)

    writer = updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def new_input_stream(
    spark: SparkSession, folder: str, table_path: str, checkpoint: str, max_files: int = 1000, **trigger: Any
) -> StreamingQuery:
    """Track ``batch_*.jsonl`` files as they appear in ``folder``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("pathGlobFilter", "batch_*.jsonl").option("maxFilesPerTrigger", max_files).load(folder)
        .select(
            F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("id"), "path", "length",
            F.col("modificationTime").alias("modified"),
        )
    )

    def apply(batch: DataFrame, epoch: int) -> None:
        found = detected_batches(batch, read_batches(spark, table_path), F.current_timestamp())
        store_upsert(found, table_path, ["created_at"], checkpoint, epoch)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
