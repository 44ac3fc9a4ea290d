"""Sharding by histogram sort: exact byte counts below key boundaries, refined until splitters hold, then one exchange.

The law is ``bytes``: shards of nearly equal size. Documents are ordered by the
hash of their text, then the hash of their id, then the row, so equal texts lie
side by side and a group of copies is cut only where a splitter falls into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import written

#: Bits of the key that one pass of counting resolves, and bits by which rows are placed within a shard.
PROBE_BITS, BIN_BITS = 12, 12
KEYS = ("_k1", "_k2", "_k3")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_id, _size, _crc`` and three key parts, each from 0 to 2**63 - 1; the third tells equal rows apart once written."""
    body = F.coalesce(F.col(text), F.lit(""))

    def positive(value: Column) -> Column:
        return F.shiftrightunsigned(value, 1)

    return docs.select(
        F.col(key).alias("_id"),
        (F.octet_length(body) + F.lit(8)).cast("bigint").alias("_size"),
        F.crc32(body).alias("_crc"),
        positive(F.xxhash64(body)).alias("_k1"),
        positive(F.xxhash64(F.col(key))).alias("_k2"),
        F.monotonically_increasing_id().alias("_k3"),
    )


class Splitter:
    """Where one shard ends: a key prefix that narrows from pass to pass.

    ``prefix`` fixes the leading key parts, ``low`` and ``bits`` the range of the
    next part that still holds the end; ``below`` counts the bytes before it.
    """

    def __init__(self, target: int):
        self.target, self.prefix, self.low, self.bits, self.below = target, (), 0, 63, 0
        self.key: tuple[int, int, int] | None = None

    @property
    def where(self) -> tuple:
        return (*self.prefix, self.low, self.bits)

    def inside(self) -> Column:
        at = len(self.prefix)
        conditions = [F.col(KEYS[i]) == v for i, v in enumerate(self.prefix)]
        conditions.append(F.shiftright(KEYS[at], self.bits) == (self.low >> self.bits))
        return reduce(lambda a, b: a & b, conditions)

    def settle(self, part: int, value: int) -> None:
        """Rows with a key of at least this go to the next shard."""
        self.key = (*self.prefix, value, *[0] * (2 - part))

    def narrow(self, counts: list[tuple[int, int, int, int]], shift: int, tolerance: int) -> None:
        """Use the bytes per probe interval, in key order: ``(interval, bytes, least key, greatest key)``."""
        at = len(self.prefix)
        below = self.below
        for interval, size, least, greatest in counts:
            if below + size <= self.target:
                below += size
                continue
            before, after = self.target - below, below + size - self.target
            if min(before, after) <= tolerance or at == 2 and least == greatest:
                self.settle(at, least if before <= after else greatest + 1)
            elif least == greatest:  # one key holds the end: go on with the next part of it
                self.prefix, self.low, self.bits, self.below = (*self.prefix, least), 0, 63, below
            else:
                self.low, self.bits, self.below = interval << shift, shift, below
            return
        self.settle(at, counts[-1][3] + 1 if counts else self.low)


def splitters(rows: DataFrame, shards: int, total: int, tolerance: int) -> list[tuple[int, int, int]]:
    """The first key of shards 1, 2, …: each pass counts all unsettled splitters' intervals in one job."""
    found = [Splitter(total * n // shards) for n in range(1, shards)]
    while open_ := [s for s in found if s.key is None]:
        ranges = {s.where: s for s in open_}
        shifts = {w: max(0, s.bits - PROBE_BITS) for w, s in ranges.items()}
        numbers = list(ranges)
        which, interval, value = None, None, None
        for n, w in enumerate(numbers):
            inside, column = ranges[w].inside(), F.col(KEYS[len(ranges[w].prefix)])
            cut = F.shiftright(column, shifts[w])
            which = F.when(inside, n) if which is None else which.when(inside, n)
            interval = F.when(inside, cut) if interval is None else interval.when(inside, cut)
            value = F.when(inside, column) if value is None else value.when(inside, column)
        # At most 2**PROBE_BITS intervals for each of the splitters, whatever the table holds.
        counted = (
            rows.select(which.alias("n"), interval.alias("i"), value.alias("v"), "_size").where("n is not null")
            .groupBy("n", "i").agg(F.sum("_size").alias("b"), F.min("v").alias("least"), F.max("v").alias("most"))
            .collect()
        )
        by_range: dict[int, list] = {n: [] for n in range(len(numbers))}
        for r in sorted(counted, key=lambda r: r["i"]):
            by_range[r["n"]].append((r["i"], r["b"], r["least"], r["most"]))
        for s in open_:
            n = numbers.index(s.where)
            s.narrow(by_range[n], shifts[numbers[n]], tolerance)
    return [s.key for s in found]


def shard_documents(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", tolerance: float = 0.0005
) -> DataFrame:
    """``key, size, text_crc32, shard, slot``: every row in one of ``shards`` shards of nearly equal bytes.

    ``size`` is the UTF-8 length of the text plus 8 (a NULL text counts as
    empty). Each end of a shard is within ``tolerance`` of a shard's share of the
    bytes, or within one row, from its exact place. ``slot`` numbers the rows of
    a shard from 0 without gaps. Equal rows, NULL keys and empty texts are rows
    like others; with fewer rows than shards some shards stay empty; an empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    rows = written(keyed(docs, key, text), "shard-keys")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    ends = splitters(rows, shards, total, int(total / shards * tolerance))

    def at_least(end: tuple[int, int, int]) -> Column:
        k1, k2, k3 = (F.col(k) for k in KEYS)
        a, b, c = map(F.lit, end)
        return (k1 > a) | ((k1 == a) & ((k2 > b) | ((k2 == b) & (k3 >= c))))

    shard = reduce(lambda a, e: a + at_least(e).cast("int"), ends, F.lit(0)) if total else F.lit(0)
    placed = rows.withColumn("shard", shard.cast("int"))
    # Bins along the key; a bin in which one text fills more than an average bin is cut by the second part too.
    first = F.shiftright("_k1", 63 - BIN_BITS)
    heavy = [
        r[0] for r in rows.groupBy(first.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 4 * F.lit(max(1, rows.count()) / 2**BIN_BITS) + 1000).collect()
    ]
    second = F.when(first.isin(heavy), F.shiftright("_k2", 63 - BIN_BITS)).otherwise(0) if heavy else F.lit(0)
    placed = placed.withColumn("_bin", (first * F.lit(1 << BIN_BITS) + second).cast("bigint"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    within = Window.partitionBy("shard", "_bin").orderBy(*KEYS)
    return (
        placed.withColumn("_place", F.row_number().over(within) - 1)
        .join(offsets.drop("_n"), ["shard", "_bin"])
        .select(
            F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
            (F.col("_before") + F.col("_place")).cast("bigint").alias("slot"),
        )
    )
