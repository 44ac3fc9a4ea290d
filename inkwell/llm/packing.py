"""Packing in optimal length buckets.

The exact histogram of all piece lengths has at most ``longest`` entries. Dynamic
programming over it chooses the bucket lengths that minimise padding over the
whole corpus. Batches of a fixed token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import token_count
from inkwell.llm.common import numbered
from inkwell.session import written

#: Tokens in the longest piece, buckets, and padded tokens in a batch.
LONGEST, BUCKETS, BUDGET = 2048, 16, 65_536


def bucket_lengths(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ascending bucket lengths, at most ``buckets``, with the least total padding for these counts of lengths.

    ``best[j]`` is the least padding of the lengths up to the j-th when the last
    bucket ends there; one more bucket at a time, over all places of its start.
    """
    lengths = sorted(n for n, count in histogram.items() if n > 0 and count > 0)
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.int64)
    count = np.array([histogram[n] for n in lengths], dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * size)])
    places = np.arange(len(lengths) + 1)
    far = np.iinfo(np.int64).max // 4
    best = np.where(places == 0, 0, far)
    starts = []
    for _ in range(min(buckets, len(lengths))):
        then, start = best.copy(), places.copy()
        for j in range(1, len(lengths) + 1):
            # Padding of one bucket that holds the lengths from i + 1 to j.
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < then[j]:
                then[j], start[j] = cost[i], i
        starts.append(start)
        best = then
    ends, j = [], len(lengths)
    for start in reversed(starts):
        if j and start[j] < j:
            ends.append(int(size[j - 1]))
            j = int(start[j])
    return ends[::-1]


def pieces(docs: DataFrame, key: str, text: str, length: Column | None, longest: int) -> DataFrame:
    """``key, piece, first_token, n_tokens``: texts longer than ``longest`` tokens in as many pieces as needed."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.coalesce(length if length is not None else token_count(body), F.lit(0)).cast("bigint")
    counted = docs.select(F.col(key), n.alias("_n"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(longest).cast("bigint"))
    each = counted.select(key, "_n", F.posexplode(starts).alias("piece", "first_token"))
    return each.select(
        key, "piece", "first_token", F.least(F.col("_n") - F.col("first_token"), F.lit(longest)).cast("bigint").alias("n_tokens")
    )


def length_buckets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: Column | None = None,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """``key, piece, first_token, n_tokens, bucket_length, batch_no, place``: every token of every text in one batch.

    ``length`` counts the tokens of a row (by default words and punctuation
    marks). A piece is padded to its bucket's length; a batch has
    ``budget // bucket_length`` places, at least one, numbered from 0, and only
    the last batch of a bucket may have fewer. NULL and empty texts are one piece
    of no tokens with NULL bucket, batch and place. Equal rows are packed each;
    an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    cut = written(pieces(docs, key, text, length, longest), "pieces")
    # At most ``longest`` rows.
    histogram = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = bucket_lengths(histogram, buckets)
    bucket = F.lit(None).cast("bigint")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("bigint")).otherwise(bucket)
    filled = cut.withColumn("bucket_length", F.when(F.col("n_tokens") > 0, bucket))
    spots = numbered(filled, "bucket_length", [key, "piece", "n_tokens"], "_spot", bins=1024)
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    return spots.select(
        key, "piece", "first_token", "n_tokens", "bucket_length",
        F.when(F.col("bucket_length").isNotNull(), F.floor(F.col("_spot") / room)).cast("bigint").alias("batch_no"),
        F.when(F.col("bucket_length").isNotNull(), F.col("_spot") % room).cast("int").alias("place"),
    )
