"""Removing repeated prompts, and giving the answers back to every copy.

The identity of a prompt is its index. What goes out keeps the index of the
first copy as ``custom_id``, so answers find their way back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import content_hash
from inkwell.operators.groups import block_of, join_to_one, latest_by, ordered_segments, without
from inkwell.session import written


def hashed(prompts: DataFrame) -> DataFrame:
    """``idx, hash`` of ``idx, text``: the text is dropped before anything is shuffled."""
    return prompts.select("idx", content_hash(F.col("text")).alias("hash"))


def fingerprints(prompts: DataFrame) -> DataFrame:
    """``idx, hash`` written once, so that several passes read the texts only once.

    The operators below also take such a table in place of the prompts.
    """
    return prompts if "hash" in prompts.columns else written(hashed(prompts), "hashes")


def _groups(prints: DataFrame) -> DataFrame:
    return prints.where(F.col("hash").isNotNull()).groupBy("hash").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("copies")
    )


def dedup_groups(prompts: DataFrame) -> DataFrame:
    """One row per distinct text: ``hash, first_idx, copies``. A prompt without text is in no group."""
    return _groups(prompts if "hash" in prompts.columns else hashed(prompts))


def later_copies(prints: DataFrame) -> DataFrame:
    """``idx, hash`` of the copies that are not the first of their text."""
    groups = _groups(prints)
    repeated = groups.where("copies > 1").select("hash", "first_idx")
    linked = join_to_one(prints.where(F.col("hash").isNotNull()), repeated, ["hash"], groups, "copies")
    return linked.where(F.col("idx") != F.col("first_idx")).select("idx", "hash")


def unique_prompts(prompts: DataFrame) -> DataFrame:
    """First copy of each text: ``idx, hash, text``. A prompt without text or index is left out.

    Copies are found on hashes, which are written once. A text without a copy
    does not move; only rows that may be later copies meet their list.
    """
    return unique_with_indices(prompts)[0]


def unique_with_indices(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unique_prompts``, and the ``idx`` of its rows alone, for which no text is read again."""
    prints = fingerprints(prompts).select("idx", "hash")
    # Both sides below meet the same list.
    later = written(later_copies(prints), "later-copies")
    rows = prompts.select("idx", "text").where(F.col("text").isNotNull() & F.col("idx").isNotNull())
    digest = content_hash(F.col("text"))
    kept = without(rows, later, ["idx"], {"hash": digest}).select("idx", digest.alias("hash"), "text")
    known = prints.where(F.col("hash").isNotNull() & F.col("idx").isNotNull())
    return kept, without(known, later, ["idx"], {"hash": F.col("hash")}).select("idx")


def missing_prompts(prompts: DataFrame) -> DataFrame:
    """``prompts``: how many have no text and so take no part in de-duplication."""
    return prompts.where(F.col("text").isNull()).agg(F.count(F.lit(1)).alias("prompts"))


def dedup_links(prompts: DataFrame) -> DataFrame:
    """One row per prompt with the first copy it stands for: ``idx, hash, first_idx``."""
    prints = fingerprints(prompts)
    groups = _groups(prints)
    return join_to_one(
        prints.select("idx", "hash"), groups.select("hash", "first_idx"), ["hash"], groups, "copies"
    ).select("idx", "hash", "first_idx")


def index_lists(prompts: DataFrame, segment_items: int = 100_000) -> DataFrame:
    """Ascending indices per hash, in segments of bounded length: ``hash, segment_no, items``."""
    prints = fingerprints(prompts).where(F.col("hash").isNotNull())
    return ordered_segments(
        prints, ["hash"], ["idx"], F.col("idx"), F.lit(1), block_of("idx", 1 << 20), segment_items
    )


def expand_results(prompts: DataFrame, results: DataFrame) -> DataFrame:
    """Give each prompt the result of its first copy; ``results`` has ``custom_id, seq, …``.

    The last of several results with one id wins. A prompt without a result is a
    row with only its ``custom_id``. Not sorted: order by the id as a number.
    """
    prints = fingerprints(prompts)
    groups = _groups(prints)
    payload = [c for c in results.columns if c not in ("custom_id", "seq")]
    last = latest_by(results, "custom_id", ["seq"]).withColumnRenamed("custom_id", "_first_id")
    # Indices find their first copy before any answer moves; answers then move once.
    links = join_to_one(prints.select("idx", "hash"), groups.select("hash", "first_idx"), ["hash"], groups, "copies")
    asked = links.select("idx", F.col("first_idx").cast("string").alias("_first_id"))
    counts = groups.select(F.col("first_idx").cast("string").alias("_first_id"), "copies")
    return join_to_one(asked, last, ["_first_id"], counts, "copies").select(F.col("idx").cast("string").alias("custom_id"), *payload)


def in_id_order(df: DataFrame, id_column: str = "custom_id") -> DataFrame:
    """Sorted by the id as a number: 2 before 10."""
    return df.orderBy(F.col(id_column).cast("bigint"))
