"""Price tables and the cost of tokens."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_TYPE = "decimal(12,4)"


class Price(NamedTuple):
    """USD per million tokens for the models whose name contains ``key``."""

    key: str
    input: Decimal
    output: Decimal
    reasoning: Decimal = Decimal(0)


# The price list for reports, in matching order, and its default.
REPORT_PRICES = (
    Price("o1-pro", Decimal("75"), Decimal("300"), Decimal("300")),
    Price("o1-mini", Decimal("8"), Decimal("12"), Decimal("12")),
    Price("gpt-4o", Decimal("3"), Decimal("15")),
    Price("gpt-4", Decimal("15"), Decimal("30")),
    Price("gpt-3.5-turbo", Decimal("0.5"), Decimal("1.5")),
)
REPORT_DEFAULT = Price("default", Decimal("10"), Decimal("30"))

# The price list for running requests; other models cost nothing.
RUN_PRICES = (
    Price("gpt-4", Decimal("30"), Decimal("60")),
    Price("gpt-4-turbo", Decimal("10"), Decimal("30")),
    Price("gpt-3.5-turbo", Decimal("0.5"), Decimal("1.5")),
)
RUN_DEFAULT = Price("none", Decimal(0), Decimal(0))


def _first_match(model: Column, prices: Sequence[Price], default: Price, field: str) -> Column:
    def value(price: Price) -> Column:
        raw = getattr(price, field)
        return F.lit(raw) if field == "key" else F.lit(raw).cast(PRICE_TYPE)

    chain = None
    for price in prices:
        hit = F.contains(model, F.lit(price.key))
        chain = F.when(hit, value(price)) if chain is None else chain.when(hit, value(price))
    return value(default) if chain is None else chain.otherwise(value(default))


def price_key(model: Column, prices: Sequence[Price] = REPORT_PRICES, default: Price = REPORT_DEFAULT) -> Column:
    """Key of the first price, in list order, that the model name contains.

    The list is a handful of rows, so it is a CASE inside the scan's own stage:
    no join, and nothing to skew.
    """
    return _first_match(model, prices, default, "key")


def price_of(
    model: Column, field: str, prices: Sequence[Price] = REPORT_PRICES, default: Price = REPORT_DEFAULT
) -> Column:
    return _first_match(model, prices, default, field)


def dollars(millionths: Column) -> Column:
    """Exact token-times-price product to USD. Dividing the decimal would cut its scale."""
    return millionths.cast("double") / F.lit(1e6)


def run_cost_millionths(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Cost of one request under the running list, case-sensitive, in millionths of a dollar."""
    return (
        prompt_tokens.cast("decimal(18,0)") * price_of(model, "input", RUN_PRICES, RUN_DEFAULT)
        + completion_tokens.cast("decimal(18,0)") * price_of(model, "output", RUN_PRICES, RUN_DEFAULT)
    ).cast("decimal(32,4)")
