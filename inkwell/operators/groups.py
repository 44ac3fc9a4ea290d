"""Ordered work inside groups of any size.

One group may hold a third of all rows, so nothing here puts a heavy group into
one task. Its rows are cut into blocks along their order; each block is worked on
by itself, the blocks' small summaries are put in order, and what they carry over
is joined back to the rows. Block numbers are a function of the row, so a task
that runs again after a lost executor does the same work. Groups that are not
heavy are one block, and where no group is heavy the carrying over is an empty
table, which AQE takes out of the plan.

Group keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import written

BLOCK_SPAN = 16_384
# Also bounds the aggregation: up to 128 segments are held per task before it sorts.
SEGMENT_CHARS = 250_000

# A key is heavy above 1/100,000 of the rows, so there are fewer than 100,000 of them.
HEAVY_PARTS = 100_000
HEAVY_FLOOR = 20_000
# Splitters of a heavy key come from so many quantiles, and are searched in strides.
QUANTILES = 4_096
STRIDE = 64


def block_of(order: Column | str, span: int | None = None) -> Column:
    """Block number for an integer position."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(span or BLOCK_SPAN))


def _blocked(df: DataFrame, keys: Sequence[str], block: Column | None, order: Sequence[str] = ()) -> DataFrame:
    """Rows with ``_heavy`` and ``_block``; only the keys are read to find heavy groups.

    Without a ``block`` of its own a heavy group is cut where its order column
    says, see ``_by_depth``.
    """
    if block is None:
        return _by_depth(df, keys, order[0])
    if not keys:
        return df.withColumn("_heavy", F.lit(True)).withColumn("_block", block.cast("bigint"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = heavy_keys(counts, keys, "_n").select(*keys, F.lit(True).alias("_heavy"))
    return (
        df.withColumn("_block", block.cast("bigint"))
        .join(F.broadcast(heavy), list(keys), "left")
        .withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))
        .withColumn("_block", F.when(F.col("_heavy"), F.col("_block")).otherwise(F.lit(0)))
    )


def _by_depth(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Blocks of about equal numbers of rows, whatever the order column's values are.

    Quantile sketches of the order column, one per heavy key and merged as an
    aggregate, give the splitters. A key is cut into as many blocks as it passes
    the heavy limit, so all keys together have fewer than ``HEAVY_PARTS`` more
    splitters than there are heavy keys. They are written before use: every task
    must cut alike. Rows that are equal in the column stay in one block.
    """
    kind = df.schema[order].dataType
    value = F.col(order)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        value = F.unix_micros(value.cast("timestamp"))
    fractions = [n / QUANTILES for n in range(1, QUANTILES)]
    narrow = df.select(*keys, value.alias("_v")).withColumn("_all_rows", F.lit(0))
    by = [*keys] or ["_all_rows"]
    heavy = written(heavy_keys(narrow.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by, "_n"), "heavy-keys")
    every = F.greatest(F.floor(F.lit(QUANTILES) / F.col("_fan")).cast("int"), F.lit(1))
    splitters = written(
        narrow.join(F.broadcast(heavy), by).groupBy(*by, "_fan")
        .agg(F.percentile_approx("_v", fractions, 10 * QUANTILES).alias("_q"))
        .select(*by, F.array_distinct(F.filter("_q", lambda q, n: (n + 1) % every == 0)).alias("_cuts")),
        "splitters",
    )
    # Two short searches in place of one along all splitters.
    coarse = F.transform(F.sequence(F.lit(1), F.floor(F.size("_cuts") / STRIDE).cast("int")), lambda n: F.element_at("_cuts", n * STRIDE))
    found = splitters.withColumn("_coarse", F.when(F.size("_cuts") >= STRIDE, coarse).otherwise(F.array().cast("array<bigint>")))
    step = F.size(F.filter("_coarse", lambda c: c < F.col("_v")))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_step") * STRIDE + 1, F.lit(STRIDE)), lambda c: c < F.col("_v")))
    return (
        df.withColumn("_v", value).withColumn("_all_rows", F.lit(0)).join(F.broadcast(found), by, "left")
        .withColumn("_heavy", F.col("_cuts").isNotNull())
        .withColumn("_step", step)
        .withColumn("_block", F.when(F.col("_heavy"), F.col("_step") * STRIDE + fine).otherwise(0).cast("bigint"))
        .withColumn("_block", F.coalesce("_block", F.lit(0).cast("bigint")))
        .drop("_v", "_all_rows", "_cuts", "_coarse", "_step")
    )


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    block: Column | None,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    ``block`` must not decrease along ``order``, and ``order`` must be unique
    within the group. Without a block the first column of ``order``, a whole
    number or a time, is cut into blocks of equal depth. The rows move once, by (keys, block); the join with the
    block totals reuses that placement.
    """
    rows = _blocked(df.withColumn("_value", value), keys, block, order)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where("_heavy").groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    base = totals.select(*keys, "_block", F.sum("_total").over(across).alias("_base"))
    zero = F.lit(0)
    return (
        rows.withColumn("_local", F.coalesce(F.sum("_value").over(within), zero))
        .join(base, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_base", zero) + F.col("_local"))
        .select(*df.columns, out)
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None, out: str = "pos"
) -> DataFrame:
    """Add the dense position, from 0, of each row within its group."""
    return running_before(df, keys, order, F.lit(1).cast("bigint"), block, out)


def previous_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    block: Column | None,
    out: str,
) -> DataFrame:
    """Add ``out``: ``value`` of the row before, NULL for the first row of the group. Blocks are as in ``running_before``."""
    rows = _blocked(df, keys, block, order)
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_block")
    last = rows.where("_heavy").groupBy(*keys, "_block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_block", F.lag("_last").over(across).alias("_carried"))
    return (
        rows.withColumn("_row", F.row_number().over(within))
        .withColumn("_lag", F.lag(value).over(within))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_lag")))
        .select(*df.columns, out)
    )


def ordered_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Column,
    size: Column,
    block: Column,
    segment_size: int = SEGMENT_CHARS,
    facts: Mapping[str, Column] | None = None,
    mark: Column | None = None,
    prefix: Callable[[Column], Column] | None = None,
    skip_null: bool = False,
) -> DataFrame:
    """Ordered lists of ``item`` per group, cut into segments of bounded size: ``keys, segment_no, items, facts``.

    An item belongs to the segment in which it starts, so a segment is at most
    ``segment_size`` plus one item, and a group smaller than that is one row.
    The segments of a group, in order, are the whole list. ``order`` must be
    unique within the group; keys may be NULL here.

    ``facts`` are whole numbers summed over the group and given with each of its
    segments. With ``mark`` each text item gets ``prefix(marks before it)`` put
    ahead. With ``skip_null`` rows without an item count in facts and marks only.

    Items move once, by (group, block): sums of sizes alone say where in its
    group a block begins. Only segments on the border of two blocks, which heavy
    groups alone have, are put together in a second exchange.
    """
    facts = {name: value.cast("bigint") for name, value in (facts or {}).items()}
    # A struct is never NULL, so joins add no filter and all uses below share one exchange.
    group = ["_group"] if keys else []
    whole = [F.struct(*keys).alias("_group")] if keys else []
    inside = [*group, "_block"]
    rows = _blocked(
        df.select(
            *whole, *order, item.alias("_item"), size.cast("bigint").alias("_size"), F.coalesce(block, F.lit(0)).alias("_span"),
            F.struct(*[value.alias(name) for name, value in facts.items()], F.lit(0).alias("_none")).alias("_facts"),
            (F.lit(0) if mark is None else mark).cast("bigint").alias("_mark"),
        ),
        group, F.coalesce("_span", F.lit(0)),
    ).withColumn("_block", F.coalesce("_block", F.lit(0)))
    earlier = Window.partitionBy(*inside).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_block")
    zero = F.lit(0).cast("bigint")

    def marked(part: DataFrame) -> DataFrame:
        """Sizes with the prefix, and the prefix."""
        if prefix is None:
            return part
        totals = rows.where("_heavy").groupBy(*inside).agg(F.sum("_mark").alias("_marks"))
        base = totals.select(*inside, (F.sum("_marks").over(across) - F.col("_marks")).alias("_marks_base"))
        local = part.withColumn("_marks_local", F.coalesce(F.sum("_mark").over(earlier), zero))
        before = F.coalesce("_marks_base", zero) + F.col("_marks_local")
        ahead = local.join(base, inside, "left").withColumn("_prefix", prefix(before))
        return ahead.withColumn("_size", F.col("_size") + F.coalesce(F.length("_prefix"), zero)).drop("_marks_base", "_marks_local")

    # Sizes only, and of heavy groups only; without one AQE leaves all of this out.
    narrow = rows.where("_heavy").select(*inside, *order, "_size", "_mark", "_facts")
    blocks = marked(narrow).groupBy(*inside).agg(
        F.sum("_size").alias("_total"), *[F.sum(f"_facts.{name}").alias(f"_f_{name}") for name in facts]
    )
    all_of = Window.partitionBy(*group)
    base = blocks.select(
        *inside, (F.sum("_total").over(across) - F.col("_total")).alias("_base"), F.sum("_total").over(across).alias("_end"),
        (F.row_number().over(across) == 1).alias("_first"), F.lead("_block").over(across).isNull().alias("_last"),
        *[F.sum(f"_f_{name}").over(all_of).alias(f"_t_{name}") for name in facts],
    )
    placed = marked(rows).withColumn("_local", F.coalesce(F.sum("_size").over(earlier), zero))
    value = F.col("_item") if prefix is None else F.concat(F.coalesce("_prefix", F.lit("")), "_item")

    def number(start: Column) -> Column:
        return F.floor(start / F.lit(segment_size)).cast("bigint")

    def cut(joined: DataFrame, on_border: bool) -> DataFrame:
        """Segments within a block; those on its border are parts of a segment."""
        segment = number(F.coalesce("_base", zero) + F.col("_local"))
        border = (~F.col("_first") & (segment == number(F.col("_base")))) | (~F.col("_last") & (segment == number(F.col("_end"))))
        border = F.coalesce(border, F.lit(False))
        sums = [F.sum(f"_facts.{name}").alias(f"_f_{name}") for name in facts]
        known = [F.first(f"_t_{name}").alias(f"_t_{name}") for name in facts]
        parts = joined.where(border if on_border else ~border).groupBy(*inside, segment.alias("segment_no")).agg(
            F.collect_list(F.struct(*order, value.alias("_item"))).alias("_entries"), *sums, *known
        )
        if on_border:
            # Named although the total is there: both branches must read the same columns to share one exchange.
            totals = [F.coalesce(F.first(f"_t_{name}"), F.sum(f"_f_{name}")).alias(name) for name in facts]
            return parts.groupBy(*group, "segment_no").agg(F.flatten(F.collect_list("_entries")).alias("_entries"), *totals)
        # Of a group in one block the facts are those of its segments.
        block_of_part = Window.partitionBy(*inside)
        return parts.select(
            *group, "segment_no", "_entries",
            *[F.coalesce(f"_t_{name}", F.sum(f"_f_{name}").over(block_of_part)).alias(name) for name in facts],
        )

    inner = cut(placed.join(base, inside, "left"), False)
    border = cut(placed.join(base, inside), True)
    entries = F.array_sort("_entries")
    if skip_null:
        entries = F.filter(entries, lambda e: e["_item"].isNotNull())
    out = inner.unionByName(border).select(
        *[F.col(f"_group.{k}").alias(k) for k in keys], "segment_no",
        F.transform(entries, lambda e: e["_item"]).alias("items"), *facts,
    )
    return out.where((F.size("items") > 0) | (F.col("segment_no") == 0)) if skip_null else out


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: Column,
    separator: str,
    block: Column,
    segment_chars: int = SEGMENT_CHARS,
    **more: Any,
) -> DataFrame:
    """Pieces of each group joined in order: ``keys, segment_no, pieces, text`` and the facts asked for.

    A NULL piece keeps its place as an empty string, unless ``skip_null`` is
    asked for. Segments are joined by the same separator as pieces. ``more`` is
    handed to ``ordered_segments``.
    """
    if not more.get("skip_null"):
        piece = F.coalesce(piece, F.lit(""))
    size = F.coalesce(F.length(piece) + len(separator), F.lit(0))
    segments = ordered_segments(df, keys, order, piece, size, block, segment_chars, **more)
    return segments.select(
        *keys,
        "segment_no",
        F.size("items").cast("bigint").alias("pieces"),
        F.array_join("items", separator).alias("text"),
        *(more.get("facts") or ()),
    )


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Add a dense global position, from 0, along ``order``.

    The rows are range-sorted and written once with partition and place in it;
    what is added afterwards is one offset per written partition. ``order``
    should tell rows apart, so that a hot value can be split.
    """
    shift = 33  # monotonically_increasing_id keeps the place in its lower 33 bits
    ranged = (
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", F.monotonically_increasing_id())
    )
    rows = (
        written(ranged, "index")
        .withColumn("_part", F.shiftright("_mark", shift))
        .withColumn("_place", F.col("_mark").bitwiseAND(F.lit((1 << shift) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition, so the size is that of the shuffle, not of the data.
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_place"))
        .select(*df.columns, out)
    )


def heavy_keys(counts: DataFrame, on: Sequence[str], n: str) -> DataFrame:
    """Keys above the heavy limit and how many ways to spread each: ``on, _fan``.

    The limit is 1/100,000 of all rows or ``HEAVY_FLOOR``, whichever is more; by
    counting, fewer than 100,000 keys can pass it, which is what makes the result
    safe to broadcast.
    """
    # Joins add this filter on one of the two uses below; said here, both share one shuffle.
    for key in on:
        counts = counts.where(F.col(key).isNotNull())
    limit = F.greatest(F.col("_all") / HEAVY_PARTS, F.lit(float(HEAVY_FLOOR)))
    total = counts.agg(F.sum(n).alias("_all"))
    return (
        counts.crossJoin(F.broadcast(total))
        .where(F.col(n) > limit)
        .select(*on, F.ceil(F.col(n) / limit).cast("int").alias("_fan"))
    )


def join_to_one(many: DataFrame, one: DataFrame, on: Sequence[str], counts: DataFrame, n: str) -> DataFrame:
    """Left join of rows to one row per key, with heavy keys spread over many tasks.

    ``counts`` holds the number of rows per key on the many side. Rows of a heavy
    key are salted by their content and its one partner row is copied to every
    salt; other keys join as they are.
    """
    heavy = F.broadcast(heavy_keys(counts, on, n))
    fan = F.coalesce("_fan", F.lit(1))
    salted = (
        many.join(heavy, list(on), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*many.columns), fan).cast("int"))
        .drop("_fan")
    )
    copied = (
        one.join(heavy, list(on), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1)))
        .drop("_fan")
    )
    return salted.join(copied, [*on, "_salt"], "left").drop("_salt")


# A list of keys up to this length is broadcast as it is; a longer one as a filter of at most 2^27 bits (16 MB).
SMALL_LIST = 200_000
MOST_FILTER_BITS = 27
BITMAP_BITS = 32_768


def without(rows: DataFrame, gone: DataFrame, on: Sequence[str], exact: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows whose key ``on`` is not in ``gone``; only rows that may be in it are moved.

    The keys of ``gone`` set bits of a filter, built as an aggregate and
    broadcast. A row whose bit is not set is let through where it lies; the
    others, those in ``gone`` and few more, are joined with it. A fuller filter
    moves more rows and changes nothing. ``exact`` names further columns of
    ``gone`` and what they are in ``rows``; they are made for rows whose key is
    in question only. NULL keys are in no list.
    """
    exact = dict(exact or {})
    gone = written(gone.select(*on, *exact).distinct(), "gone")
    count = gone.count()
    if not count:
        return rows

    def checked(df: DataFrame, near: bool) -> DataFrame:
        listed = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in (*on, *exact)])
        same = [F.col(c) == F.col(f"_gone_{c}") for c in on]
        # Not an equality to join on: it is looked at only where the key is met.
        same += [F.array_contains(F.array(f"_gone_{name}"), value) for name, value in exact.items()]
        return df.join(F.broadcast(listed) if near else listed, reduce(and_, same), "left_anti")

    if count <= SMALL_LIST:
        return checked(rows, True)
    bits = min(MOST_FILTER_BITS, (16 * count).bit_length())
    place = F.shiftrightunsigned(F.xxhash64(*on), 64 - bits)
    bucket, at = F.floor(place / BITMAP_BITS).cast("int"), place % BITMAP_BITS
    # At most 2^27 / 2^15 rows of 4 KB.
    filled = gone.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    marked = rows.withColumn("_bucket", bucket).withColumn("_at", at.cast("int")).join(F.broadcast(filled), "_bucket", "left")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.get(F.split(F.lpad(F.conv(byte, 10, 2), 8, "0"), ""), 7 - F.col("_at") % 8) == "1", F.lit(False))
    through = marked.where(~hit).select(*rows.columns)
    return through.unionByName(checked(marked.where(hit).select(*rows.columns), False))


def latest_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row per key. Pre-aggregated before the shuffle, so a hot key is one row per task."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )
