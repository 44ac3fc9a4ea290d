"""Checks on answers: structure, errors and retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response codes worth another try.
RETRY_STATUS = (429, 500, 502, 503, 504)

STRUCTURED_FIELDS = "summary STRING, key_points ARRAY<STRING>"


def parse_structured(content: Column) -> Column:
    """``valid, summary, key_points, error`` of an answer that should be JSON.

    Valid means an object with a string ``summary`` and a list of strings
    ``key_points``. ``from_json`` would turn 1 into "1", so the types are read
    from the parsed variant first.
    """
    parsed = F.try_parse_json(content)
    shape = F.schema_of_variant(parsed)
    summary_type = F.schema_of_variant(F.try_variant_get(parsed, "$.summary", "variant"))
    points_type = F.schema_of_variant(F.try_variant_get(parsed, "$.key_points", "variant"))
    fields = F.from_json(content, STRUCTURED_FIELDS)
    valid = F.coalesce(
        shape.startswith("OBJECT")
        & (summary_type == "STRING")
        & points_type.isin("ARRAY<STRING>", "ARRAY<VOID>")
        & F.forall(fields["key_points"], lambda p: p.isNotNull()),
        F.lit(False),
    )
    error = F.when(parsed.isNull(), "Invalid JSON").when(~valid, "Response does not match schema")
    return F.struct(
        valid.alias("valid"),
        F.when(valid, fields["summary"]).alias("summary"),
        F.when(valid, fields["key_points"]).alias("key_points"),
        error.alias("error"),
    )


def classify_error(message: Column) -> Column:
    lowered = F.lower(message)

    def says(*parts: str) -> Column:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(lowered, F.lit(part))
        return hit

    return (
        F.when(says("401", "authentication", "api key"), "authentication")
        .when(says("429"), "rate_limit")
        .when(says("400") & says("model"), "invalid_model")
        .when(says("400"), "bad_request")
        .when(says("404", "not found"), "not_found")
        .otherwise("other")
    )


def retryable(status: Column, attempt: Column, max_retries: int = 3) -> Column:
    """Whether attempt number ``attempt`` (from 0) is followed by another."""
    return F.coalesce(status.isin(*RETRY_STATUS), F.lit(False)) & (attempt < max_retries)


def retry_delay(attempt: Column, base: float = 1.0) -> Column:
    """Planned wait after an attempt (from 0), before any jitter."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def poll_backoff(failures: Column, base: float = 10.0) -> Column:
    """Wait after the n-th failed poll in a row (from 1)."""
    return F.lit(base) * F.pow(F.lit(2.0), failures - 1)
