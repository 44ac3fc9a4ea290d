"""Spending and rate limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.groups import running_before

# What the service lets through per minute.
TOKENS_PER_MINUTE = 60_000
REQUESTS_PER_MINUTE = 3_000


def budget_cutoff(
    requests: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: float | None, block: Column | None = None
) -> DataFrame:
    """Add ``spent_before`` and ``admitted``. A request runs while earlier ones cost
    less than the budget, so the one that crosses it still runs; 0 or None is no limit."""
    spent = running_before(requests, keys, order, F.col(cost), block, "spent_before")
    admitted = F.col("spent_before") < F.lit(budget) if budget else F.lit(True)
    return spent.withColumn("admitted", admitted)


def rate_usage(
    requests: DataFrame,
    ts: str = "ts",
    tokens: str = "tokens",
    keys: Sequence[str] = (),
    token_limit: int = TOKENS_PER_MINUTE,
    request_limit: int = REQUESTS_PER_MINUTE,
) -> DataFrame:
    """Tokens and requests per minute against the limits. Works on streams with a watermark."""
    used = requests.groupBy(*keys, F.window(ts, "1 minute").alias("_w")).agg(
        F.sum(tokens).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("requests")
    )
    over = (F.col("tokens") > token_limit) | (F.col("requests") > request_limit)
    return used.select(*keys, F.col("_w.start").alias("minute"), "tokens", "requests", over.alias("over_limit"))

