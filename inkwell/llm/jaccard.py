"""Exact Jaccard join of shingle sets in their metric space: cells, regions, pivots, triangle-inequality windows.

The Jaccard distance is a metric. Its coarsest parts are the cells of single
shingles: two sets within the threshold share one of the first shingles of each
in a common order, so every set belongs to the cells of its first shingles and
no others. The order puts shingles of one document first, then rare ones (their
document frequencies are counted over all documents): a text of its own has no
cell at all, and a common passage makes none. Sets that are equal are one node
from the start.

Cells with a member in common are one region, so all sets within the threshold
of each other are in one region, and a region's sets move once. In a region, sets
are pivots one after the other: what links to a pivot is one component with it,
and two sets of different components can only be within the threshold if their
distances to each pivot differ by no more (the triangle inequality). A set with
no such partner left is done, and so is the region when what is not done is one
component. Regions of many sets are cut into blocks: blocks are done first, then
one set of each block's largest component meets all blocks, and what is outside
of the region's largest component then meets all blocks, group by group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from inkwell.llm.bpe import kind
from inkwell.llm.common import SLICE, bound_batches
from inkwell.session import written

#: Words in a shingle; links need 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Shingles in more documents than this are common, and the most common so many have their frequency known.
COMMON, MOST_COMMON = 32, 1 << 20
#: A region with more pairs than this is cut into blocks, which have about so many pairs each.
OPEN_PAIRS, PIVOT_PAIRS = 1 << 20, 1 << 20
#: A block has about so many shingles at most, and a region of more is cut too.
BLOCK_ITEMS = 1 << 20
#: Pivots whose distances are kept for windows.
PIVOTS = 8
#: Places of the map of shingles in several documents, from and to, and how many a document is worth.
SHARED_PLACES, MOST_SHARED_PLACES, SHARED_PER_DOC = 1 << 27, 1 << 29, 64
#: Document frequencies from which a place has the levels 1 to 3.
RARE = (2, 5, 13)
#: Bytes of texts that are cut up at a time, and shingles that a task counts at a time; one longer text is a slice of its own.
SLICE_BYTES, COUNTED = 4 << 20, 1 << 20
#: Edges that a task has at a time when it reduces them.
EDGES = 1 << 20
#: Bits of the map of texts whose sets are needed. False positives of either map cost time only.
BITMAP = 1 << 26
_FACTORS = np.array([0x9E3779B97F4A7C15 + 2 * (i * 0x632BE59BD9B4E019 % 2**62) for i in range(WORDS)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words than a shingle has, of all words as one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        rows = len(h) - n + 1
        total = np.full(rows, n, np.uint64)
        for i in range(n):
            total = total * np.uint64(0x100000001B3) + h[i : i + rows] * _FACTORS[i]
    total = mixed(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def node_of(found: np.ndarray, salt: int) -> tuple[int, int]:
    """Number of a set, and a second hash that would tell two sets with one number apart."""
    digest = blake2b(found.tobytes(), digest_size=16, salt=salt.to_bytes(2, "little")).digest()
    return int.from_bytes(digest[:8], "little") >> 1, int.from_bytes(digest[8:], "little") >> 1


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``SLICE`` rows and ``SLICE_BYTES`` of ``text`` at a time: long texts make many shingles."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + SLICE_BYTES
            to = max(at + 1, min(at + SLICE, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def dealt(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    """``range, data, again, times`` of about ``COUNTED`` shingles each: their distinct 32 bits above ``low``, and which came how often again."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        values = np.concatenate(held)
        held.clear()
        values >>= np.uint64(low)
        values, n = np.unique(values, return_counts=True)
        places = (values >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(places)) + 1
        parts = np.split(values.astype(np.uint32), cut)
        more = [(part[c > 1], (c[c > 1] - 1).astype(np.uint32)) for part, c in zip(parts, np.split(n, cut))]
        return pa.RecordBatch.from_pydict({
            "range": pa.array(places[np.concatenate([[0], cut])].astype(np.int32)),
            "data": pa.array([p.tobytes() for p in parts], pa.binary()),
            "again": pa.array([p.tobytes() for p, _ in more], pa.binary()),
            "times": pa.array([c.tobytes() for _, c in more], pa.binary()),
        })

    for part in slices(batches):
        for text in part.column("text").to_pylist():
            found = shingles(text)
            held.append(found)
            size += len(found)
        if size > COUNTED:
            yield flush()
            size = 0
    if size:
        yield flush()


def shingle_counts(texts: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """What is known of document frequencies: the common shingles' levels, and a map of those in several documents.

    Every document's distinct shingles are counted, in as many ranges of the hash
    as keep a range's numbers few; a task counts before it sends. Counted are the
    range and the 32 bits below; two shingles that have them in common count as
    one, which only makes them seem less rare. The first result is how far a
    hash is shifted to have those bits, then at most ``MOST_COMMON`` entries
    ``bits << 8 | level``, sorted, the most frequent; the second is a map by the
    upper bits of the hash, two bits a place: the highest level of its shingles by
    ``RARE``, above 0 where a shingle may stand in more than one document.
    """
    width = max(6, min(20, (max(n_docs, 1) // 500).bit_length()))
    places_ = min(MOST_SHARED_PLACES, max(SHARED_PLACES, 1 << (SHARED_PER_DOC * n_docs - 1).bit_length()))
    per_range, place_shift = places_ >> width, np.uint64(32 + width - (places_.bit_length() - 1))

    def counted(table: pa.Table) -> pa.Table:
        values, again, times = (
            np.concatenate([np.frombuffer(b, np.uint32) for b in table.column(c).to_pylist()]) for c in ("data", "again", "times")
        )
        bits, n = np.unique(values, return_counts=True)
        np.add.at(n, np.searchsorted(bits, again), times)
        number = table.column("range")[0].as_py()
        whole = bits.astype(np.uint64) | np.uint64(number << 32)
        rare = np.zeros(per_range, np.uint8)
        several = n >= RARE[0]
        at = (whole[several] >> place_shift).astype(np.int64) - number * per_range
        np.maximum.at(rare, at, np.digitize(n[several], RARE).astype(np.uint8))
        packed = np.bitwise_or.reduce(rare.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1)
        kept = n > COMMON
        none = [None] * int(kept.sum())
        return pa.table({
            "bits": pa.array([None, *whole[kept].tolist()], pa.int64()),
            "n": pa.array([None, *n[kept].tolist()], pa.int64()),
            "range": pa.array([number, *none], pa.int32()),
            "marks": pa.array([packed.tobytes(), *none], pa.binary()),
        })

    found = written(
        texts.mapInArrow(lambda batches: dealt(batches, 32 - width), "range int, data binary, again binary, times binary").groupBy("range")
        .applyInArrow(counted, "bits bigint, n bigint, range int, marks binary"),
        "shingle-counts",
    )
    common = found.where("bits is not null").select("bits", "n").orderBy(F.desc("n"), "bits").limit(MOST_COMMON).toPandas()
    levels = np.log2(np.maximum(common["n"].to_numpy(np.float64), 1)).astype(np.int64)
    shared = np.zeros(places_ // 4, np.uint8)
    for r in found.where("range is not null").select("range", "marks").collect():
        start = r["range"] * per_range // 4
        shared[start : start + per_range // 4] = np.frombuffer(bytes(r["marks"]), np.uint8)
    return np.concatenate([[32 - width], np.sort(common["bits"].to_numpy(np.int64) << 8 | levels)]).astype(np.int64), shared


def ordered(found: np.ndarray, common: np.ndarray, shift: int = 32, rare: np.ndarray | int = 0) -> np.ndarray:
    """The shingles: those of one document, then by how rare and how common they are, then by hash."""
    if not len(found):
        return found
    level = np.zeros(len(found), np.int64) + rare
    if len(common):
        bits = (found >> np.uint64(shift)).astype(np.int64)
        at = np.minimum(np.searchsorted(common, bits << 8), len(common) - 1)
        level = np.maximum(level, np.where(common[at] >> 8 == bits, common[at] & 255, 0))
    return found[np.lexsort((found, level))]


def first_shingles(docs: DataFrame, common: Broadcast, shared: Broadcast, salt: int, percent: int) -> DataFrame:
    """``id, k, n, node, check, first``: each row's set size and number, and the cells it belongs to.

    Of the first shingles those that stand in no other document are left out of
    ``first``: their cells would have one member.
    """
    id_type = kind(docs, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, known = np.split(np.frombuffer(common.value, np.int64), [1])
        marks = np.frombuffer(shared.value, np.uint8)
        place_shift = np.uint64(65 - (len(marks) * 4).bit_length())

        def rare(found: np.ndarray) -> np.ndarray:
            place = (found >> place_shift).astype(np.int64)
            return (marks[place >> 2] >> (2 * (place & 3)).astype(np.uint8)) & 3

        def cells(found: np.ndarray) -> np.ndarray:
            # A partner has at least percent of the size and so shares one of these.
            first = ordered(found, known, int(shift[0]), rare(found))[: len(found) - -(-len(found) * percent // 100) + 1]
            return first[rare(first) > 0].view(np.int64)

        for part in slices(batches):
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            nodes = [node_of(s, salt) if len(s) else (None, None) for s in sets]
            first = [cells(s) if len(s) else s.view(np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in first])])
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("k"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([n for n, _ in nodes], pa.int64()), pa.array([c for _, c in nodes], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
            ], names=["id", "k", "n", "node", "check", "first"])

    return docs.mapInArrow(run, f"id {id_type}, k bigint, n bigint, node bigint, check bigint, first array<bigint>")


def sets_of(docs: DataFrame, needed: DataFrame, salt: int) -> DataFrame:
    """``node, items``: the whole sets of the needed nodes, each once. Only texts that the bitmap lets through are cut up."""
    # Places count from 1: the bucket of place 0 is one of its own.
    place = F.pmod("k", F.lit(BITMAP)) + 1
    bits = needed.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )
    # At most BITMAP / 8 bytes, whatever is needed.
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for r in bits.collect():
        start = (r["b"] - 1) * 4096
        bitmap[start : start + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for part in slices(batches):
            bit = part.column("bit").to_numpy()
            bucket = part.column("bucket").to_numpy()
            at = (bucket - 1) * 4096 + (bit >> 3)
            kept = part.filter(pa.array((known[at] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            sets = [s for s in map(shingles, kept.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([node_of(s, salt)[0] for s in sets], pa.int64()),
                "items": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            })

    placed = docs.select("text", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    found = written(placed.mapInArrow(run, "node bigint, items array<bigint>"), "sets")
    if np.bitwise_count(bitmap).sum() > 0.05 * BITMAP:  # so full that it lets through much that is not needed
        found = found.join(needed.select("node"), "node", "left_semi")
    once = found.groupBy("node").count().where("count > 1").isEmpty()
    return found if once else found.dropDuplicates(["node"])


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        for ends in (u, v, label[u], label[v]):
            np.minimum.at(after, ends, least)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def reduced(links: DataFrame) -> DataFrame:
    """Edges ``a, b`` that tie the same nodes: of each task at most one for a node, to the smallest it is tied to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            nodes, least = smallest(*(np.concatenate(x) for x in zip(*held)))
            return nodes[nodes != least], least[nodes != least]

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size > EDGES:
                a, b = stars()
                held, size = [(a, b)], len(a)
                if size > EDGES // 2:
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                    held, size = [], 0
        if size:
            a, b = stars()
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none: then the edges lead to the smallest nodes."""
    ends = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
    return ends.groupBy("u").agg(F.sum("n").alias("up"), F.count(F.lit(1)).alias("all")).where("up > 0 and all > 1").isEmpty()


def labelled(links: DataFrame) -> DataFrame:
    """``node, comp`` of the nodes of edges ``a, b`` that lead to the smallest node of each component."""
    least = links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(least)


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node of each node's component; nodes without links are left out.

    Large and small stars in turn: every node's larger neighbours, then the
    smaller ones, are tied to the smallest, until all edges lead to it.
    """
    edges = reduced(links).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.where("u <> v").distinct(), "edges")
    last = None
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        print_ = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        edges = after
        if print_ == last:
            break
        last = print_
    return labelled(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))


def joined(sets: list[np.ndarray], comp: np.ndarray, asked: np.ndarray, percent: int) -> np.ndarray:
    """Components, numbered by their smallest label, after all links between an asked set and any other.

    Asked sets are pivots one after the other: counted are the shingles that each
    set has in common with the pivot. A set without a partner in another component
    that the sizes and the windows of the pivots before leave possible is passed
    over. Where all sets are asked, those of the largest component are too: all
    others have met them.
    """
    comp, n, total = comp.copy(), np.array([len(s) for s in sets], np.int64), len(sets)
    owner = np.repeat(np.arange(total), n)
    words, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    lists = owner[np.argsort(at, kind="stable")]
    ends, starts = np.cumsum(df), np.cumsum(n) - n
    begins = ends - df
    distances: list[np.ndarray] = []
    reach, every = 1 - percent / 100 + 1e-9, bool(asked.all())
    open_ = asked.copy()
    while True:
        waiting = open_
        if every:
            labels, sizes = np.unique(comp, return_counts=True)
            waiting = open_ & (comp != labels[sizes.argmax()])
        if not waiting.any():
            return comp
        pivot = int(waiting.argmax())
        open_[pivot] = False
        possible = (comp != comp[pivot]) & (100 * np.minimum(n, n[pivot]) >= percent * np.maximum(n, n[pivot]))
        for d in distances:
            possible &= np.abs(d - d[pivot]) <= reach
        if not possible.any():
            continue
        own = at[starts[pivot] : starts[pivot] + n[pivot]]
        many = df[own]
        places = np.repeat(begins[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(lists[places], minlength=total)
        either = n + n[pivot] - both
        tied = np.unique(comp[100 * both >= percent * either])
        comp[np.isin(comp, tied)] = tied[0]
        # The windows of pivots that are near to many sets say most.
        distances = sorted([*distances, 1 - both / either], key=lambda d: (d >= 1).sum())[:PIVOTS]


def region_links(members: DataFrame, percent: int, *keys: str) -> DataFrame:
    """``a, b``: which components ``comp`` of each group of members ``keys, comp, asked, items`` the links tie together.

    At most as many rows as a group has components come out, whatever the number of links.
    """

    def run(table: pa.Table) -> pa.Table:
        sets = [np.asarray(s) for c in table.column("items").chunks for s in (c[i].values.to_numpy() for i in range(len(c)))]
        before = table.column("comp").to_numpy()
        after = joined(sets, before, table.column("asked").to_numpy(), percent)
        pairs = np.unique(np.stack([before, after], 1)[before != after], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return members.select(*keys, "comp", "asked", "items").groupBy(*keys).applyInArrow(run, "a bigint, b bigint")


class Join:
    """One join: nodes, their regions and the links that tie components together."""

    def __init__(self, docs: DataFrame, rows: DataFrame, salt: int, percent: int):
        self.docs, self.salt, self.percent = docs, salt, percent
        # Rows with one node have one set, so any of them stands for it.
        self.nodes = written(
            rows.where("node is not null").groupBy("node").agg(F.min("k").alias("k"), F.min("n").alias("n"), F.first("first").alias("first")),
            "nodes",
        )

    def regions(self) -> DataFrame:
        """``s, node, k, n, block, blocks``: the members of regions, and how each region is cut."""
        cells = self.nodes.select("node", F.explode("first").alias("c"))
        pivots = cells.groupBy("c").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last")
        tied = components(cells.join(pivots, "c").where("node <> b").select(F.col("node").alias("a"), "b"))
        members = tied.withColumnRenamed("comp", "s").join(self.nodes.select("node", "k", "n"), "node")
        members = written(members, "members")
        size = members.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
        parts = F.greatest(F.ceil(F.col("m") / F.sqrt(F.lit(2 * PIVOT_PAIRS))), F.ceil(F.col("items") / BLOCK_ITEMS))
        cut = (F.col("m") * (F.col("m") - 1) / 2 > OPEN_PAIRS) | (F.col("items") > BLOCK_ITEMS)
        size = size.select("s", F.when(cut, parts).otherwise(1).cast("int").alias("blocks"))
        return members.join(size, "s").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    def run(self) -> DataFrame:
        """``node, comp`` of all linked nodes."""
        regions = written(self.regions(), "regions")
        sets = sets_of(self.docs, regions.select("k", "node"), self.salt)
        members = regions.join(sets, "node").withColumns({"comp": F.col("node"), "asked": F.lit(True)})
        links = written(region_links(members, self.percent, "s", "block"), "links")
        cut = regions.where("blocks > 1")
        if cut.isEmpty():
            # A region's links all lead to the smallest nodes of its components.
            return labelled(links)
        cut = written(cut.join(sets, "node").select("s", "node", "block", "blocks", "n", "items"), "cut")
        # One set of each block's largest component meets all blocks.
        now = self.with_comps(cut, labelled(links))
        largest = now.groupBy("s", "block", "comp").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("node"))
        largest = largest.groupBy("s", "block").agg(F.max_by("node", "m").alias("node")).select("s", "node")
        links = written(links.unionByName(self.across(now, now.join(largest, ["s", "node"], "left_semi"))), "links")
        # What is outside of the largest component meets all blocks.
        now = self.with_comps(cut, written(components(links), "components"))
        largest = now.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(F.max_by("comp", "m").alias("comp"))
        links = links.unionByName(self.across(now, now.join(largest, ["s", "comp"], "left_anti")))
        return written(components(links), "components")

    def with_comps(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members with ``comp``, their component so far."""
        return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def across(self, members: DataFrame, asked: DataFrame) -> DataFrame:
        """Links of the asked sets with the sets of all other blocks of their region.

        Asked sets go in groups of a block's size, and each group meets each
        block in a task.
        """
        size = asked.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
        parts = F.greatest(F.ceil(F.col("m") / F.sqrt(F.lit(2 * PIVOT_PAIRS))), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
        size = size.select("s", parts.alias("groups"))
        columns = ["s", "block", "group", "comp", "asked", "items"]
        stay = members.join(size, "s").withColumns({"group": F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), "asked": F.lit(False)})
        go = asked.join(size, "s").withColumns({"group": F.pmod(F.xxhash64(F.lit(1), "node"), "groups").cast("int"), "asked": F.lit(True)})
        go = go.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block").drop("block").withColumnRenamed("to", "block")
        return region_links(stay.select(columns).unionByName(go.select(columns)), self.percent, "s", "block", "group")


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest key that links lead to. NULL and empty texts
    and texts of white space alone have no shingles, link with nothing and have
    their own key; equal sets link always, also those of one repeated row; a row
    with a NULL key takes part and gets its component's smallest key. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("k"), F.col(text).alias("text"))
    n_docs = docs.count()
    # Both have a fixed greatest size.
    common, shared = (
        spark.sparkContext.broadcast(x.tobytes()) for x in shingle_counts(docs.select(F.col(text).alias("text")), n_docs)
    )
    salt = 0
    while True:
        rows = written(first_shingles(texts, common, shared, salt, percent), "first-shingles")
        doubled = rows.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
        if doubled.isEmpty():
            break
        salt += 1  # two sets had one number
    join = Join(texts.select("k", "text"), rows, salt, percent)
    found = rows.select("id", "n", "node")
    grouped = found.join(join.run(), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component"))
    return grouped.join(least, "comp", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
