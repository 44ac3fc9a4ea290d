"""Writers. NULL fields are left out of JSON, which is how optional fields go missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines, in a folder per value of ``partition_by`` (``batch_no``, say)."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "true")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result lines per ``batch_id``; only the batches given are replaced."""
    (
        results.write.mode("overwrite").partitionBy("batch_id")
        .option("partitionOverwriteMode", "dynamic").json(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and empty strings stay bare."""
    (
        df.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def export_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, NULLs kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_store(outcomes: DataFrame, path: str) -> None:
    """Append ``prompt, response`` rows to the store."""
    outcomes.select("prompt", "response").write.mode("append").json(path)
