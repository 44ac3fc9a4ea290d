"""Whitening of embeddings with exact integer covariance from bit planes.

Components become integers. Shifted so that none is negative, bit ``b`` of
dimension ``d`` over many vectors is one row of words (a plane); the product of
two dimensions summed over the vectors is then the sum over pairs of planes of
``2^(b + b') * popcount(plane & plane')``, which is exact, adds up over tasks in
any order and does not need the vectors in one place. The covariance is centred
as integers, and only then made into doubles for its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches
from inkwell.session import written

#: Words of all planes together that a task holds at a time (32 MB).
PLANE_WORDS = 1 << 22
#: Counts are weighted by 2^0 to 2^(STEP-1) before they are added up; the rest of the weight is in ``part``.
STEP = 16
COMPONENTS = 4


def encode(x: np.ndarray) -> list[bytes]:
    """One byte string per row of integers; equal rows, and only those, have equal strings."""
    out: list[bytes] = [b""] * len(x)
    width = np.full(len(x), 8)
    if x.shape[1]:
        low, high = x.min(axis=1), x.max(axis=1)
        for w in (4, 2, 1):
            limit = 1 << 8 * w - 1
            width[(low >= -limit) & (high < limit)] = w
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        data, size = x[at].astype(f"<i{w}").tobytes(), int(w) * x.shape[1]
        mark = bytes([w])
        for n, i in enumerate(at.tolist()):
            out[i] = mark + data[n * size : (n + 1) * size]
    return out


def decode(codes: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(codes), dims), np.int64)
    width = np.fromiter((c[0] for c in codes), np.int64, len(codes))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(codes[i][1:] for i in at.tolist()), f"<i{w}").reshape(-1, dims)
    return out


def integer_rows(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``_key, _dims, _x`` of the rows whose components all are finite and fit into 64 bits."""
    source = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, _dims int, _x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(values * scale)
            fine = np.isfinite(x) & (x >= -(2.0**63)) & (x < 2.0**63)
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~fine)])
            usable = wrong[ends] == wrong[ends - sizes]
            for dims in np.unique(sizes[usable]).tolist():
                at = np.flatnonzero(usable & (sizes == dims))
                cells = (ends[at] - dims)[:, None] + np.arange(dims)
                codes = encode(x[cells].astype(np.int64).reshape(len(at), dims))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dims, np.int32)), pa.array(codes, pa.binary())],
                    names=["_key", "_dims", "_x"],
                )

    return source.mapInArrow(run, schema)


def bounds(rows: DataFrame, dims: int) -> list[tuple[int, int]]:
    """Least and greatest value per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = decode(batch.column(0).to_pylist(), dims)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    found = rows.select("_x").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(F.min("low"), F.max("high"))
    return [(r[1], r[2]) for r in sorted(found.collect())]


def planes_of(x: np.ndarray, low: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of all dimensions in order, low bits first, as rows of 64-bit words."""
    shifted = x.view(np.uint64) - low.view(np.uint64)  # wraps to the right value: the difference fits into 64 bits
    words = -(-len(x) // 64)
    out = np.zeros((sum(bits), words * 8), np.uint8)
    at = 0
    for d, n in enumerate(bits):
        column = shifted[:, d]
        for b in range(n):
            packed = np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def add_products(planes: np.ndarray, bits: list[int], products: np.ndarray, sums: np.ndarray) -> None:
    """Add the weighted popcounts of all pairs of planes: ``products[part, d, e]`` for d <= e, ``sums[part, d]``."""
    dim = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(n) for n in bits]) if len(dim) else np.empty(0, np.int64)
    own = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    np.add.at(sums, (bit // STEP, dim), own << (bit % STEP))
    for p in range(len(dim)):
        count = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
        weight = bit[p] + bit[p:]
        # Two bits of one dimension meet once here and twice in its square.
        weight[1:] += dim[p + 1 :] == dim[p]
        np.add.at(products, (weight // STEP, dim[p], dim[p:]), count << (weight % STEP))


def cross_products(rows: DataFrame, dims: int, low: list[int], bits: list[int]) -> tuple[list[int], list[list[int]]]:
    """Sums and sums of products of the shifted components over all rows; the driver gets at most dims^2/2 numbers a part."""
    parts = 2 * max(bits, default=0) // STEP + 1
    chunk = max(1, PLANE_WORDS // max(1, sum(bits))) * 64
    least = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((parts, dims, dims), np.int64), np.zeros((parts, dims), np.int64)
        waiting, held = [], 0

        def pack() -> None:
            x = np.concatenate(waiting)
            for at in range(0, len(x), chunk):
                add_products(planes_of(x[at : at + chunk], least, bits), bits, products, sums)
            waiting.clear()

        for batch in batches:
            waiting.append(decode(batch.column(0).to_pylist(), dims))
            held += batch.num_rows
            if held >= min(chunk, PLANE_WORDS // dims + 1):
                pack()
                held = 0
        if waiting:
            pack()
        for part in range(parts):
            d, e = np.nonzero(products[part])
            yield cells(part, d, e, products[part][d, e])
            (d,) = np.nonzero(sums[part])
            yield cells(part, d, np.full(len(d), -1), sums[part][d])

    def cells(part, d, e, value) -> pa.RecordBatch:
        whole = [np.full(len(d), part), d, e, value]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in whole], names=["part", "d", "e", "value"])

    counted = rows.select("_x").mapInArrow(run, "part long, d long, e long, value long").groupBy("part", "d", "e")
    total = [0] * dims
    matrix = [[0] * dims for _ in range(dims)]
    # Decimal: a sum of longs over all tasks may pass 64 bits.
    for r in counted.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        weighted = int(r["value"]) << STEP * r["part"]
        if r["e"] < 0:
            total[r["d"]] += weighted
        else:
            matrix[r["d"]][r["e"]] += weighted
            if r["d"] != r["e"]:
                matrix[r["e"]][r["d"]] += weighted
    return total, matrix


@dataclass(frozen=True)
class Whitening:
    """``vectors`` has a unit eigenvector per column, by falling eigenvalue; ``sums`` are exact, over ``n`` vectors."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def defined(self) -> np.ndarray:
        """Components whose variance is above what rounding leaves of zero."""
        most = self.values[0] if len(self.values) else 0.0
        return self.values > most * self.dims * np.finfo(np.float64).eps

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exactly; Python's integers where 64 bits may not do."""
        kind = np.int64 if self.reach() < 2**63 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def reach(self) -> int:
        """No part of ``n * x - sums`` is larger."""
        return max((max(abs(self.n * v), abs(s)) * 2 for b in (self.low, self.high) for v, s in zip(b, self.sums)), default=0)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Squared lengths of the centred rows; None where one passes 64 bits."""
        if self.dims * self.reach() ** 2 < 2**63:
            return (centred**2).sum(axis=1).tolist()
        exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in exact]

    def project(self, centred: np.ndarray, count: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (centred.astype(np.float64) / self.n) @ self.vectors[:, :count] / np.sqrt(np.maximum(self.values[:count], 0.0))


def eigen(n: int, total: list[int], matrix: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues, unit eigenvectors as columns and trace of the covariance, centred as integers."""
    exact = [[n * m - a * b for m, b in zip(row, total)] for row, a in zip(matrix, total)]
    covariance = np.array([[c / (n * n) for c in row] for row in exact], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Either sign is right; this one does not depend on the library.
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, range(len(total))] < 0, -1.0, 1.0)
    return values, vectors, sum(exact[d][d] for d in range(len(total))) / (n * n)


def fit(rows: DataFrame, dims: int) -> Whitening:
    """From ``_x`` of distinct rows of ``dims`` components each."""
    ends = bounds(rows, dims)
    low, high = [e[0] for e in ends], [e[1] for e in ends]
    bits = [(h - v).bit_length() for v, h in ends]
    n = rows.count()
    total, matrix = cross_products(rows, dims, low, bits)
    values, vectors, trace = eigen(n, total, matrix)
    sums = tuple(t + n * v for t, v in zip(total, low))
    return Whitening(n, sums, tuple(low), tuple(high), values, vectors, trace)


def identity_error(rows: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the covariance of whitened rows, minus the identity; None without a component."""
    use = np.flatnonzero(model.defined()[:components])
    dims = model.dims
    if not len(use):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(use)
        sums, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = model.project(model.centred(decode(batch.column(0).to_pylist(), dims)), components)[:, use]
            sums += w.sum(axis=0)
            products += w.T @ w
        at = np.indices((size, size + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(np.column_stack([products, sums]).ravel())], names=["i", "j", "value"]
        )

    found = rows.select("_x").mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("v")).collect()
    table = np.zeros((len(use), len(use) + 1))
    for r in found:
        table[r["i"], r["j"]] = r["v"] / model.n
    mean = table[:, -1]
    return float(np.abs(table[:, :-1] - np.outer(mean, mean) - np.eye(len(use))).max())


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = 256.0
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component.

    A component ``c`` becomes the integer ``floor(scale * c)``. Unusable are
    vectors that are NULL, that hold a NULL, a NaN, an infinity or a value whose
    integer passes 64 bits, and those of another length than most usable vectors
    have (of equally frequent lengths the largest counts). The covariance is over
    distinct integer vectors, each once, so repeated rows and hot vectors have no
    weight, yet each row has its result; rows without a key too. ``n`` and
    ``deviation`` (squared length of ``n * x - sums``) are exact; a deviation
    past 64 bits is NULL. Along a component without variance ``whitened`` is NULL
    and ``identity_error`` does not look; ``explained`` is then 0, or NULL if
    nothing varies at all. An empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    coded = written(integer_rows(df, key, vector, scale), "vectors")
    schema = (
        f"{key} {coded.schema['_key'].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    usual = coded.groupBy("_dims").count().orderBy(F.desc("count"), F.desc("_dims")).first()
    if usual is None or usual["_dims"] == 0:
        return spark.createDataFrame([], schema)
    dims = usual["_dims"]
    rows = coded.where(F.col("_dims") == dims)
    distinct = written(rows.select("_x").distinct(), "vectors-once")
    model = fit(distinct, dims)
    count = min(components, dims)
    error = identity_error(distinct, model, count)
    defined = model.defined()[:count]
    share = [float(max(e, 0.0)) / model.trace if model.trace else None for e in model.values[:count]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = model.centred(decode(batch.column(1).to_pylist(), dims))
            size = batch.num_rows * count
            white = np.where(defined, model.project(centred, count), np.nan).ravel()
            each = np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(size, model.n, np.int64)),
                    pa.array(model.deviations(centred), pa.int64()).take(pa.array(each)),
                    pa.array(white, pa.float64(), mask=np.tile(~defined, batch.num_rows)),
                    pa.array(share * batch.num_rows, pa.float64()),
                    pa.array([error] * size, pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("_key", "_x").mapInArrow(run, schema)
