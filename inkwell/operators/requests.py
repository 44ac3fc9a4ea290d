"""Request records, cutting them into batches, and the cost of sending them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.pricing import REPORT_DEFAULT, REPORT_PRICES, Price, dollars, price_of
from inkwell.functions.text import sanitize, token_count
from inkwell.operators.groups import dense_index

# What a request is sent as, the model used when another is not
# available, and the models offered when the service lists none.
METHOD = "POST"
URL = "/v1/chat/completions"
FALLBACK_MODEL = "gpt-3.5-turbo"
FALLBACK_MODELS = (
    "o1-mini", "o1-preview", "gpt-4o", "gpt-4o-mini", "gpt-4-turbo",
    "gpt-3.5-turbo", "gpt-4", "gpt-4-vision-preview", "gpt-4-32k",
)
COMPATIBLE = "(?i)o1|gpt|text-embedding"


def takes_reasoning_effort(model: Column) -> Column:
    return F.contains(F.lower(model), F.lit("o1"))


def build_requests(
    prompts: DataFrame,
    model: Column | str,
    reasoning_effort: str = "medium",
    temperature: float = 0.7,
    max_tokens: int = 1024,
    response_format: str = "json_object",
) -> DataFrame:
    """Request records for ``custom_id, text``; other columns pass through.

    Optional body fields are NULL where they do not apply, so JSON leaves them out.
    """
    model = F.lit(model) if isinstance(model, str) else model
    message = F.struct(F.lit("user").alias("role"), sanitize(F.col("text")).alias("content"))
    wants_json = F.lit(response_format == "json_object")
    body = F.struct(
        model.alias("model"),
        F.array(message).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(float(temperature)).alias("temperature"),
        F.when(takes_reasoning_effort(model), F.lit(reasoning_effort)).alias("reasoning_effort"),
        F.when(wants_json, F.struct(F.lit("json_object").alias("type"))).alias("response_format"),
    )
    kept = [c for c in prompts.columns if c not in ("custom_id", "text")]
    return prompts.select(
        *kept, "custom_id", F.lit(METHOD).alias("method"), F.lit(URL).alias("url"), body.alias("body")
    )


def batch_size(total: Column, max_batch_size: int = 5000) -> Column:
    """All requests if they fit; else the first size, in steps of 500 down to above
    1,000, that leaves a remainder under 100; else the maximum."""
    whole = F.lit(max_batch_size).cast("bigint")
    if max_batch_size <= 1000:
        fitting = whole
    else:
        sizes = F.sequence(whole, F.lit(1001).cast("bigint"), F.lit(-500).cast("bigint"))
        fitting = F.coalesce(F.get(F.filter(sizes, lambda s: total % s < 100), F.lit(0)), whole)
    return F.when(total <= max_batch_size, total).otherwise(fitting)


def assign_batches(
    requests: DataFrame,
    index: str = "idx",
    total: DataFrame | None = None,
    max_batch_size: int = 5000,
    ids: Column | None = None,
) -> DataFrame:
    """Add ``batch_no, custom_id, start_item, end_item`` from a dense index.

    Ids start again at 0 in every batch, so the key is (batch_no, custom_id).
    Prompts that were de-duplicated keep the index of their first copy instead:
    give it as ``ids``, or the answers cannot be spread to the copies.
    """
    if total is None:
        total = requests.agg(F.count(F.lit(1)).alias("_total"))
    sized = total.select("_total", batch_size(F.col("_total"), max_batch_size).alias("_size"))
    start = (F.col("batch_no") * F.col("_size")).cast("bigint")
    custom_id = F.col(index) % F.col("_size") if ids is None else ids
    return (
        requests.crossJoin(F.broadcast(sized))  # one row
        .withColumn("batch_no", F.floor(F.col(index) / F.col("_size")).cast("bigint"))
        .withColumn("custom_id", custom_id.cast("string"))
        .withColumn("start_item", start)
        .withColumn("end_item", F.least(start + F.col("_size"), F.col("_total")))
        .drop("_total", "_size")
    )


def assign_batches_in_order(
    requests: DataFrame, order: Sequence[str], max_batch_size: int = 5000, ids: Column | None = None, unique: bool = False,
    keys: DataFrame | None = None,
) -> DataFrame:
    """As ``assign_batches`` for rows without a dense index; adds ``position`` as well.

    Where ``order`` is ``unique``, positions are found on it alone and the rest
    of the rows moves once, to meet them; else whole rows are sorted. ``keys``
    may hold the ``order`` of all rows where that is cheaper to read than the rows.
    """
    if unique:
        positions = dense_index((requests if keys is None else keys).select(*order), order, "position")
        placed = requests.join(positions, list(order))
    else:
        placed = dense_index(requests, order, "position")
    # A total of the rows themselves reads them once more.
    total = None
    if unique and keys is not None:
        total = keys.select(*order).join(positions.select(*order), list(order)).agg(F.count(F.lit(1)).alias("_total"))
    return assign_batches(placed, "position", total, max_batch_size=max_batch_size, ids=ids)


def failed_batches(batched: DataFrame, failures: DataFrame) -> DataFrame:
    """Batches that could not be sent: ``batch_index`` (from 1), ``start_item, end_item, error``.

    ``failures`` has ``batch_no, error``. The other batches go on.
    """
    spans = batched.select("batch_no", "start_item", "end_item").distinct()
    return spans.join(failures, "batch_no").select(
        (F.col("batch_no") + 1).alias("batch_index"), "start_item", "end_item", "error"
    )


def cost_by_model(
    results: DataFrame, prices: Sequence[Price] = REPORT_PRICES, default: Price = REPORT_DEFAULT
) -> DataFrame:
    """Tokens and USD per lower-cased model, and a total row with model ``NULL``.

    Tokens are summed before the shuffle and priced once per model. Decimals keep
    the sums exact; dollars are made last.
    """
    model = F.lower(F.coalesce("model", F.lit("default")))
    kinds = ("input", "output", "reasoning")
    tokens = [F.sum(F.coalesce(f"{k}_tokens", F.lit(0))).cast("bigint").alias(f"{k}_tokens") for k in kinds]
    priced = [
        (F.col(f"{k}_tokens").cast("decimal(20,0)") * price_of(F.col("model"), k, prices, default)).alias(f"_{k}")
        for k in kinds
    ]
    per_model = (
        results.groupBy(model.alias("model"))
        .agg(F.count(F.lit(1)).alias("requests"), *tokens)
        .select("*", *priced)
    )
    sums = [F.sum(f"{k}_tokens").alias(f"{k}_tokens") for k in kinds]
    costs = [F.sum(f"_{k}").alias(f"_{k}") for k in kinds]
    whole = F.col("_input") + F.col("_output") + F.col("_reasoning")
    return (
        per_model.rollup("model")
        .agg(F.grouping("model").cast("int").alias("is_total"), F.sum("requests").alias("requests"), *sums, *costs)
        .select(
            "model", "is_total", "requests", *[f"{k}_tokens" for k in kinds],
            *[dollars(F.col(f"_{k}")).alias(f"{k}_cost") for k in kinds],
            dollars(whole).alias("total_cost"),
        )
    )


def estimate_batch_cost(
    prompts: DataFrame,
    model: Column | str,
    max_tokens: int = 1024,
    budget: float | None = None,
    prices: Sequence[Price] = REPORT_PRICES,
    default: Price = REPORT_DEFAULT,
) -> DataFrame:
    """One row: prompts, estimated tokens and USD, and whether the budget holds (equality does)."""
    model = F.lit(model) if isinstance(model, str) else model
    usage = prompts.select(
        model.alias("model"),
        token_count(F.col("text")).alias("input_tokens"),
        F.lit(max_tokens).cast("bigint").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("reasoning_tokens"),
    )
    total = cost_by_model(usage, prices, default).where("is_total = 1")
    within = F.lit(True) if budget is None else F.coalesce(F.col("total_cost") <= budget, F.lit(True))
    return total.select(
        F.col("requests").alias("prompts"),
        F.col("input_tokens").alias("total_input_tokens"),
        F.col("output_tokens").alias("total_output_tokens"),
        "input_cost", "output_cost", "reasoning_cost", "total_cost",
        F.lit(budget).cast("double").alias("budget"),
        within.alias("within_budget"),
    )


class BudgetExceeded(ValueError):
    """The estimate of a run is above its budget."""


def enforce_budget(prompts: DataFrame, model: Column | str, max_tokens: int, budget: float | None) -> DataFrame:
    """The prompts unchanged, or ``BudgetExceeded``. Reads one row back."""
    if budget is not None:
        estimate = estimate_batch_cost(prompts, model, max_tokens, budget).first()
        if estimate is not None and not estimate["within_budget"]:
            raise BudgetExceeded(
                f"Estimated cost ${estimate['total_cost']:.4f} exceeds budget ${budget:.2f}"
            )
    return prompts


def compatible_models(models: DataFrame, column: str = "model") -> DataFrame:
    """Distinct models fit for batches; the fallback list where none is."""
    found = models.where(F.col(column).rlike(COMPATIBLE)).select(column).distinct()
    spare = models.sparkSession.createDataFrame([(m,) for m in FALLBACK_MODELS], f"{column} string")
    none_found = found.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return found.unionByName(spare.crossJoin(F.broadcast(none_found)).select(column))


def resolve_model(model: Column, available: Sequence[str], fallback: str = FALLBACK_MODEL) -> Column:
    """The model if the service offers it, else the fallback. The list is the service's own, so short."""
    return F.when(model.isin(*available), model).otherwise(F.lit(fallback))


def resolve_models(requested: DataFrame, available: DataFrame, fallback: str = FALLBACK_MODEL) -> DataFrame:
    """``model, requests, resolved`` for the distinct models asked for."""
    wanted = requested.groupBy("model").agg(F.count(F.lit(1)).alias("requests"))
    offered = available.select(F.col("model").alias("_offered")).distinct()
    return wanted.join(offered, F.col("model") == F.col("_offered"), "left").select(
        "model", "requests",
        F.when(F.col("_offered").isNull(), F.lit(fallback)).otherwise(F.col("_offered")).alias("resolved"),
    )
