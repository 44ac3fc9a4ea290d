"""Result and error lines: parsing, flattening, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.answers import parse_structured
from inkwell.functions.text import strip
from inkwell.schemas import ERROR_LINE, RESULT_LINE


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested results to flat rows: missing text '' and missing counts 0, first choice only.

    ``role`` is NULL where there is no message. Columns that are not part of a
    result line (a batch id, say) are kept in front.
    """
    known = {f.name for f in RESULT_LINE.fields}
    extra = [c for c in results.columns if c not in known]
    first = F.get("choices", F.lit(0))["message"]

    def text(column: Column) -> Column:
        return F.coalesce(column, F.lit(""))

    def count(name: str) -> Column:
        return F.coalesce(F.col(f"usage.{name}"), F.lit(0)).cast("bigint")

    # Already parsed results carry the text in ``content``.
    content = F.coalesce(first["content"], F.col("content")) if "content" in results.columns else first["content"]
    return results.select(
        *extra,
        text(F.col("custom_id")).alias("custom_id"),
        text(F.col("status")).alias("status"),
        text(F.col("created_at")).alias("created_at"),
        count("prompt_tokens").alias("input_tokens"),
        count("completion_tokens").alias("output_tokens"),
        count("reasoning_tokens").alias("reasoning_tokens"),
        count("total_tokens").alias("total_tokens"),
        text(F.col("model")).alias("model"),
        text(content).alias("content"),
        F.when(first.isNotNull(), text(first["role"])).alias("role"),
    )


def flatten_errors(errors: DataFrame) -> DataFrame:
    known = {f.name for f in ERROR_LINE.fields}
    extra = [c for c in errors.columns if c not in known]

    def named(column: str) -> Column:
        return F.coalesce(column, F.lit("Unknown"))

    return errors.select(
        *extra,
        named("custom_id").alias("custom_id"),
        named("error.type").alias("error_type"),
        named("error.message").alias("error_message"),
    )


def parse_lines(lines: DataFrame, schema=RESULT_LINE, value: str = "value") -> DataFrame:
    """JSON lines to columns; blank lines are skipped and a bad line raises."""
    extra = [c for c in lines.columns if c != value]
    record = F.from_json(value, schema, {"mode": "FAILFAST"})
    return lines.where(strip(F.col(value)) != "").select(*extra, record.alias("_r")).select(*extra, "_r.*")


def parse_result_lines(lines: DataFrame, service_status: Column | None = None) -> DataFrame:
    """Result lines to flat rows, with a valid structured answer replaced by its summary.

    Nothing is read from a batch whose service status is not ``completed``.
    """
    if service_status is not None:
        lines = lines.where(service_status == "completed")
    flat = flatten_results(parse_lines(lines))
    checked = flat.withColumn("_parsed", parse_structured(F.col("content")))
    return checked.withColumn("content", F.coalesce("_parsed.summary", "content")).drop("_parsed")


def result_view(flat: DataFrame) -> DataFrame:
    return flat.select("custom_id", "content", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


def token_totals(flat: DataFrame) -> DataFrame:
    kinds = ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
    return flat.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in kinds])


def outcomes(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Successes and errors of a batch in one set, both kept and told apart by ``kind``."""
    return flatten_results(results).withColumn("kind", F.lit("result")).unionByName(
        flatten_errors(errors).withColumn("kind", F.lit("error")), allowMissingColumns=True
    )


def pair_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompt text beside its response, by ``(batch_id, custom_id)``."""
    return prompts.join(responses, ["batch_id", "custom_id"])
