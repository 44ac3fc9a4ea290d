"""Exact top-k search by distributed histogram selection.

Queries meet all candidates in blocks. Every pass scores everything and counts,
per query, how many scores fall into each bin of the range that still holds the
k-th best; the global counts choose the bin for the next pass, until bins are
one wide and the k-th score is known. A last pass keeps what lies above it and,
among its ties, the smallest ids. No pass keeps scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches
from inkwell.session import written

#: Vectors in a block of candidates and of queries, and bins of a histogram.
CANDIDATES, QUERIES, BINS = 1024, 256, 8192

BLOCK = "dim int, block bigint, ids array<bigint>, rows array<bigint>, data binary"


def whole_components(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; NULL unless all components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def vectors(df: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """``id, dim, v, asked, row``: usable rows, each with a number that is fixed once written."""
    usable = df.select(
        F.col(key).cast("bigint").alias("id"), whole_components(F.col(vector)).alias("v"), is_query.alias("asked")
    ).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    return written(
        usable.select("id", F.size("v").alias("dim"), "v", "asked").withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one dimension in blocks of at most ``size``, packed where they are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            data = np.array([r[1] for r in rows], dtype=np.int64).tobytes()
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "block": pa.array([rows[0][2]], pa.int64()),
                "ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                "rows": pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), "data": pa.array([data], pa.binary()),
            })

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                for id_, dim, v, row in zip(*[c.slice(at, size).to_pylist() for c in batch.columns]):
                    held.setdefault(dim, []).append((id_, v, row))
                    if len(held[dim]) == size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.select("id", "dim", "v", "row").mapInArrow(pack, BLOCK)


def matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def inner_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits it raises."""
    dim = queries.shape[1]
    if not dim:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = [max(abs(int(m.max())), abs(int(m.min()))) for m in (queries, candidates)]
    bound = most[0] * most[1] * dim
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T
    return exact.astype(np.int64)


def grid(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int) -> DataFrame:
    """Every query block beside every candidate block of its dimension, over a grid of cells.

    Either side is copied along one edge of the grid only; the edges are chosen
    so that the copies of both weigh about the same.
    """
    width = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tall = max(1, min(width, n_candidates, math.ceil(math.sqrt(width * max(1, n_candidates) / max(1, n_queries)))))
    wide = max(1, min(n_queries, math.ceil(width / tall)))
    left = queries.withColumn("_wide", F.pmod(F.xxhash64("block"), F.lit(wide))).withColumn(
        "_tall", F.explode(F.sequence(F.lit(0), F.lit(tall - 1)))
    )
    right = candidates.select(
        F.col("dim"), F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"),
        F.col("data").alias("c_data"), F.pmod(F.xxhash64("block"), F.lit(tall)).alias("_tall"),
    ).withColumn("_wide", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    return left.join(right, ["dim", "_tall", "_wide"])


def scored(pairs: DataFrame, columns: list[str], function, ddl: str) -> DataFrame:
    """Rows that ``function(scores, c_ids, own, *columns)`` gives for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):

                def numbers(name: str) -> np.ndarray:
                    return batch.column(name)[at].values.to_numpy()

                rows, c_rows = numbers("rows"), numbers("c_rows")
                scores = inner_products(
                    matrix(batch.column("data")[at].as_py(), len(rows)), matrix(batch.column("c_data")[at].as_py(), len(c_rows))
                )
                own = rows[:, None] == c_rows[None, :]
                out = function(scores, numbers("c_ids"), own, rows, *map(numbers, columns))
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    needed = ["rows", "data", "c_ids", "c_rows", "c_data", *columns]
    return pairs.select(*needed).mapInArrow(run, ddl)


def count_bins(k: int, bins: int):
    def counts(scores, c_ids, own, rows, low, width):
        found: dict[str, list] = {"row": [], "bin": [], "n": []}
        for i, row in enumerate(rows):
            if not width[i]:
                continue  # its k-th score is known
            line = scores[i][~own[i]]
            offset = line - low[i]
            inside = offset[(offset >= 0) & (offset < width[i])] // -(-width[i] // bins)
            # Below the bin where this block alone has k scores the k-th best cannot lie.
            values, n = np.unique(inside, return_counts=True)
            last = int(np.searchsorted(np.cumsum(n[::-1]), k)) + 1
            for b, m in zip(values[::-1][:last].tolist(), n[::-1][:last].tolist()):
                found["row"].append(int(row)), found["bin"].append(b), found["n"].append(m)
        return found

    return counts


def keep_best(k: int):
    def best(scores, c_ids, own, rows, ids, least):
        found: dict[str, list] = {"row": [], "query_id": [], "vec_id": [], "score": []}
        for i, row in enumerate(rows):
            usable = ~own[i]
            ties = np.flatnonzero(usable & (scores[i] == least[i]))
            ties = ties[np.argsort(c_ids[ties], kind="stable")[:k]]
            kept = np.concatenate([np.flatnonzero(usable & (scores[i] > least[i])), ties])
            found["row"] += [int(row)] * len(kept)
            found["query_id"] += [int(ids[i])] * len(kept)
            found["vec_id"] += c_ids[kept].tolist()
            found["score"] += scores[i][kept].tolist()
        return found

    return best


def top_k(
    table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", bins: int = BINS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best inner products of each query row with every other row.

    ``is_query`` is a condition on the rows of ``table``. Rows with a NULL key, a NULL vector
    or a NULL or non-finite component take no part, vectors of different lengths
    do not meet, empty vectors score 0. A row is left out of its own result only:
    an equal row counts, and repeated query rows give repeated results. Ties go
    to the smaller id. Empty tables give no rows; other columns are not read.
    """
    bound_batches(table.sparkSession)
    rows = vectors(table, is_query, key, vector)
    asked = rows.where("asked")
    c_blocks = written(blocks_of(rows, CANDIDATES), "candidate-blocks")
    q_blocks = written(blocks_of(asked, QUERIES), "query-blocks")
    n_candidates, n_queries = c_blocks.count(), q_blocks.count()

    # By Cauchy and Schwarz no score is beyond the product of the longest vectors of a dimension.
    longest = rows.groupBy("dim").agg(F.max(norm(F.col("v"))).alias("_most"))
    beyond = F.ceil(norm(F.col("v")) * F.col("_most") * (1 + 1e-9)) + 1
    state = asked.join(longest, "dim").select(
        "row", (-beyond).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("above")
    )
    # A query's k-th score lies in the ``width`` values from ``low`` up; ``above`` scores lie beyond them.
    state = written(state.withColumn("width", 1 - 2 * F.col("low")), "bounds")
    step = F.ceil(F.col("width") / bins).cast("bigint")
    while state.agg(F.max("width")).first()[0]:
        pairs = grid(with_state(q_blocks, state, ["low", "width"]), c_blocks, n_queries, n_candidates)
        counts = scored(pairs, ["low", "width"], count_bins(k, bins), "row bigint, bin bigint, n bigint")
        totals = counts.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin"))
        reached = totals.withColumn("_upto", F.sum("n").over(down)).join(state, "row")
        first = reached.where(F.col("above") + F.col("_upto") >= k).groupBy("row").agg(
            F.max_by(F.struct("bin", (F.col("_upto") - F.col("n")).alias("before")), "bin").alias("_hit")
        )
        # Queries with fewer than k others keep all of them: the lower end stays.
        hit = F.col("_hit").isNotNull()
        state = written(
            state.join(first, "row", "left").select(
                "row",
                F.when(hit, F.col("low") + F.col("_hit.bin") * step).otherwise(F.col("low")).alias("low"),
                (F.col("above") + F.coalesce("_hit.before", F.lit(0))).cast("bigint").alias("above"),
                F.when(hit & (step > 1), step).otherwise(F.lit(0)).cast("bigint").alias("width"),
            ),
            "bounds",
        )
    pairs = grid(with_state(q_blocks, state, ["low"]), c_blocks, n_queries, n_candidates)
    kept = scored(pairs, ["ids", "low"], keep_best(k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def with_state(blocks: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Query blocks with arrays of the named state columns, in the order of their rows."""
    each = blocks.select("dim", "block", F.posexplode("rows").alias("_at", "row")).join(state, "row")
    entry = F.array_sort(F.collect_list(F.struct("_at", *names)))
    lists = each.groupBy("dim", "block").agg(entry.alias("_state"))
    return blocks.join(lists, ["dim", "block"]).select(
        *blocks.columns, *[F.col("_state").getField(n).alias(n) for n in names]
    )
