"""Per-minute usage of a stream of requests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.limits import rate_usage


def rate_usage_stream(requests: DataFrame, delay: str | None = "10 minutes", **options: Any) -> DataFrame:
    """``rate_usage`` of a stream with ``ts, tokens``; state is dropped ``delay`` after its minute.

    Without a delay no row is ever late and all minutes are kept: for backlogs,
    which end, and whose files come in no time order.
    """
    return rate_usage(requests if delay is None else requests.withWatermark("ts", delay), **options)


def write_updates(usage: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Write the minutes each micro-batch touched under ``epoch=N``; a repeated epoch replaces itself."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = usage.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(apply).trigger(**(trigger or {"availableNow": True})).start()


def current_usage(spark, path: str) -> DataFrame:
    """The newest row per minute from what ``write_updates`` wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("minute", "epoch")]
    newest = rows.groupBy("minute").agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return newest.select("minute", "_r.*")
