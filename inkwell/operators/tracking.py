"""The batch table: updates, listings, statistics, housekeeping.

Results and errors live in child tables keyed by ``batch_id``. They are counted
per batch before they meet the batch table, so one batch holding most results is
one row by then.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.pricing import REPORT_DEFAULT, REPORT_PRICES, Price, dollars, price_of
from inkwell.functions.text import fixed_text, grouped_digits
from inkwell.functions.times import format_time, older_than, utc_clock
from inkwell.operators.batch_table import read_batches, store_delete, store_upsert  # noqa: F401
from inkwell.operators.groups import latest_by, previous_in_group
from inkwell.session import path_exists  # noqa: F401

# Statuses a batch is still worked on in, and those it ends in.
ACTIVE = ("in_progress", "validating")
TERMINAL = ("completed", "failed", "expired", "cancelled")


def _iso(moment: Column) -> Column:
    return F.date_format(utc_clock(moment), "yyyy-MM-dd'T'HH:mm:ss")


def active_batches(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("status").isin(*ACTIVE))


def terminal_batches(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("status").isin(*TERMINAL))


def filter_batches(batches: DataFrame, statuses: Iterable[str] = (), models: Iterable[str] = ()) -> DataFrame:
    """Rows with one of the statuses and one of the models; an empty set does not filter."""
    statuses, models = list(statuses), list(models)
    if statuses:
        batches = batches.where(F.col("status").isin(*statuses))
    if models:
        batches = batches.where(F.col("model").isin(*models))
    return batches


def batch_by_id(batches: DataFrame, batch_id: str) -> DataFrame:
    return batches.where(F.col("id") == batch_id)


def completed_with_results(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Completed batches that have results. Ids are made distinct first, so a big batch is one row."""
    with_results = results.select(F.col("batch_id").alias("id")).distinct()
    return batches.where(F.col("status") == "completed").join(with_results, "id", "left_semi")


def distinct_models(batches: DataFrame) -> DataFrame:
    return batches.select(F.coalesce("model", F.lit("Unknown")).alias("model")).distinct()


def all_batch_ids(*sets: DataFrame) -> DataFrame:
    """Ids from every given set, distinct and sorted."""
    ids = sets[0].select("id")
    for other in sets[1:]:
        ids = ids.union(other.select("id"))
    return ids.distinct().orderBy("id")


def rows_per_batch(child: DataFrame, out: str) -> DataFrame:
    return child.groupBy(F.col("batch_id").alias("id")).agg(F.count(F.lit(1)).alias(out))


def batch_listing(batches: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    def named(column: str) -> Column:
        return F.coalesce(column, F.lit("Unknown")).alias(column)

    counted = batches.join(rows_per_batch(results, "results"), "id", "left").join(
        rows_per_batch(errors, "errors"), "id", "left"
    )
    return counted.select(
        "id", named("status"), named("created_at"), named("model"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("request_count", "results", "errors")],
    )


def batch_stats(batches: DataFrame) -> DataFrame:
    """One row of counts by status class; expired and cancelled count as other."""
    named = ("in_progress", "completed", "failed")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in named]
    rest = F.col("total_batches") - F.col("in_progress") - F.col("completed") - F.col("failed")
    return batches.agg(F.count(F.lit(1)).alias("total_batches"), *counts).withColumn("other_status", rest)


def requests_by_model(batches: DataFrame, results: DataFrame) -> DataFrame:
    """``model, requests, share`` over completed batches; the share is of all their results."""
    counted = batches.where(F.col("status") == "completed").join(rows_per_batch(results, "_n"), "id")
    per_model = counted.groupBy(F.coalesce("model", F.lit("Unknown")).alias("model")).agg(
        F.sum("_n").alias("requests")
    )
    whole = Window.partitionBy()  # one row per model is left
    return per_model.withColumn("share", F.col("requests") / F.sum("requests").over(whole))


def allocated_cost(
    batches: DataFrame,
    flat_results: DataFrame,
    prices: Sequence[Price] = REPORT_PRICES,
    default: Price = REPORT_DEFAULT,
) -> DataFrame:
    """All tokens of completed batches spread over models by their share of requests, and priced."""
    completed = batches.where(F.col("status") == "completed").select("id")
    kinds = ("input", "output", "reasoning")
    sums = [F.sum(f"{k}_tokens").alias(f"_{k}") for k in kinds]
    per_batch = flat_results.groupBy(F.col("batch_id").alias("id")).agg(*sums)
    totals = per_batch.join(completed, "id", "left_semi").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in kinds])
    shared = requests_by_model(batches, flat_results).crossJoin(F.broadcast(totals))  # one row
    model = F.lower("model")
    return shared.select(
        "model", "requests", "share",
        *[(F.col(f"_{k}") * F.col("share")).alias(f"{k}_tokens") for k in kinds],
        *[
            dollars(F.col(f"_{k}") * F.col("share") * price_of(model, k, prices, default).cast("double")).alias(f"{k}_cost")
            for k in kinds
        ],
    ).withColumn("total_cost", F.col("input_cost") + F.col("output_cost") + F.col("reasoning_cost"))


def batch_summary(
    batches: DataFrame,
    flat_results: DataFrame,
    errors: DataFrame,
    prices: Sequence[Price] = REPORT_PRICES,
    default: Price = REPORT_DEFAULT,
) -> DataFrame:
    """Counts, success rate, tokens and cost per batch.

    ``summed_tokens`` is input + output + reasoning, which differs from the sum
    of the ``total_tokens`` that came with the results.
    """
    kinds = ("input", "output", "reasoning")
    per_model = (
        flat_results.groupBy(F.col("batch_id").alias("id"), F.lower("model").alias("_m"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"{k}_tokens").alias(f"_{k}") for k in kinds])
    )

    def priced(kind: str) -> Column:
        return F.col(f"_{kind}").cast("decimal(20,0)") * price_of(F.col("_m"), kind, prices, default)

    cost = priced("input") + priced("output") + priced("reasoning")
    per_batch = per_model.withColumn("_cost", cost).groupBy("id").agg(
        F.sum("_n").alias("results"),
        *[F.sum(f"_{k}").alias(f"{k}_tokens") for k in kinds],
        F.sum("_cost").alias("_cost"),
    )
    joined = batches.join(per_batch, "id", "left").join(rows_per_batch(errors, "errors"), "id", "left")

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)

    counted = joined.select(
        "id",
        F.coalesce("status", F.lit("Unknown")).alias("status"),
        format_time(F.col("created_at")).alias("created"),
        F.coalesce("model", F.lit("Unknown")).alias("model"),
        count("results"), count("errors"), *[count(f"{k}_tokens") for k in kinds],
        dollars(F.coalesce("_cost", F.lit(0).cast("decimal(38,4)"))).alias("cost"),
    )
    requests = F.col("results") + F.col("errors")
    return counted.withColumn(
        "success_rate", F.when(requests > 0, F.col("results") / requests * 100).otherwise(F.lit(0.0))
    ).withColumn("summed_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens"))


def summary_text(summary: DataFrame) -> DataFrame:
    """``id, text``: the summary as lines; token and cost lines only where there are results."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value.cast("string"))

    head = [
        line("Status", F.col("status")), line("Created", F.col("created")), line("Model", F.col("model")),
        line("Results", F.col("results")), line("Errors", F.col("errors")),
        F.concat(line("Success Rate", fixed_text(F.col("success_rate"), 1)), F.lit("%")),
    ]
    tail = [
        line("Input Tokens", grouped_digits(F.col("input_tokens"))),
        line("Output Tokens", grouped_digits(F.col("output_tokens"))),
        line("Total Tokens", grouped_digits(F.col("summed_tokens"))),
        F.concat(F.lit("Estimated Cost: $"), fixed_text(F.col("cost"), 4)),
    ]
    lines = F.when(F.col("results") > 0, F.array(*head, *tail)).otherwise(F.array(*head))
    return summary.select("id", F.array_join(lines, "\n").alias("text"))


def prune_batches(batches: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Batches left after those older than ``days`` are dropped."""
    return batches.where(~older_than(F.col("created_at"), as_of, days))


def old_batches(batches: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return batches.where(older_than(F.col("created_at"), as_of, days))


def untracked(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files whose ``id`` is in no tracked row. Tracked ids are made distinct first."""
    return files.join(tracked.select("id").distinct(), "id", "left_anti")


def detected_batches(files: DataFrame, tracked: DataFrame, now: Column) -> DataFrame:
    """Batch rows with status ``detected`` for input files nobody tracks.

    ``files`` has ``id, path, length, modified``. The creation time is the second
    ``_`` part of the name if that is all digits, else the file's.
    """
    stamp = F.regexp_extract("id", r"^[^_]*_(\d+)(_|$)", 1).try_cast("bigint")
    created = F.coalesce(F.timestamp_seconds(stamp), F.col("modified"), now)
    metadata = F.create_map(
        F.lit("input_file"), F.col("path"), F.lit("auto_detected"), F.lit("true"),
        F.lit("file_size"), F.col("length").cast("string"),
    )
    return untracked(files, tracked).select(
        "id",
        F.lit("detected").alias("status"),
        _iso(created).alias("created_at"),
        F.lit(None).cast("string").alias("model"),
        F.lit(0).cast("bigint").alias("request_count"),
        _iso(now).alias("last_updated"),
        metadata.alias("metadata"),
    )


def storage_usage(files: DataFrame) -> DataFrame:
    """``files, bytes, megabytes`` of a listing with ``length``."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    ).withColumn("megabytes", F.col("bytes") / F.lit(1024.0 * 1024.0))


def upsert_batches(current: DataFrame, updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Whole rows added or replaced by id; the last update of an id wins.

    ``updates`` has the columns of ``current`` and those of ``order``.
    """
    last = latest_by(updates, "id", order).select(*current.columns)
    return current.join(last.select("id"), "id", "left_anti").unionByName(last)


def update_batches(current: DataFrame, changes: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """Fields of existing batches set where a change gives them; unknown ids are ignored."""
    given = [c for c in changes.columns if c in current.columns and c not in ("id", "last_updated")]
    last = latest_by(changes, "id", order).select("id", *[F.col(c).alias(f"_{c}") for c in given])
    hit = last.withColumn("_hit", F.lit(True))
    joined = current.join(hit, "id", "left")
    fields = []
    for name in current.columns:
        if name in given:
            fields.append(F.coalesce(f"_{name}", name).alias(name))
        elif name == "last_updated":
            fields.append(F.when(F.col("_hit"), _iso(now)).otherwise(F.col(name)).alias(name))
        else:
            fields.append(F.col(name))
    return joined.select(*fields)


def delete_batches(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id").distinct(), "id", "left_anti")


def status_changes(
    seen: DataFrame, block: Column | None = None, key: str = "id", order: Sequence[str] = ("ts",), status: str = "status"
) -> DataFrame:
    """Rows whose status differs from the one before, the first of each id included. NULL is a status like others."""
    # As a struct, a NULL status differs from there being no row before.
    seen = seen.withColumn("_entry", F.struct(F.col(status).alias("status")))
    with_previous = previous_in_group(seen, [key], order, "_entry", block, "_before").drop("_entry")
    previous = F.col("_before.status")
    changed = with_previous.where(F.col("_before").isNull() | ~previous.eqNullSafe(F.col(status)))
    return changed.withColumn("previous", previous).drop("_before")


def poll_timeouts(
    seen: DataFrame,
    as_of: Column,
    timeout_minutes: int = 1440,
    key: str = "id",
    status: str = "status",
    ts: str = "ts",
    sequence: str | None = None,
) -> DataFrame:
    """Per id: first and last sighting, last status, and whether polling has run out.

    Polling runs out when the last status is not terminal and more than the
    timeout has passed since the first sighting. A missing status is ``unknown``.
    Of sightings at one time the last by ``sequence`` counts, without one the
    greatest status.
    """
    last = seen.groupBy(key).agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.max_by(status, F.struct(ts, sequence or status)).alias("_status"),
    )
    waited = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))
    final = F.coalesce("_status", F.lit("unknown"))
    overdue = ~final.isin(*TERMINAL) & (waited > timeout_minutes * 60 * 1_000_000)
    return last.select(key, "first_seen", "last_seen", final.alias("final_status"), overdue.alias("timed_out"))
