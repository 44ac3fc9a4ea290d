"""Whitening against a plain version in exact fractions and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from inkwell.llm import whitening
from inkwell.llm.queries import QUERIES


def usable(vector):
    return vector is not None and all(v is not None and math.isfinite(v) and abs(256.0 * v) < 2.0**63 for v in vector)


def plain(rows):
    """``{(id, component): …}`` of rows whose vectors all have one length, exactly up to the eigenvectors."""
    ints = [(i, tuple(math.floor(256 * float(v)) for v in x)) for i, x in rows if usable(x)]
    fit = list(dict.fromkeys(x for _, x in ints))
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    scatter = [[sum(Fraction((n * x[a] - sums[a]) * (n * x[b] - sums[b]), n * n) for x in fit) / n for b in range(dims)] for a in range(dims)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in scatter]))
    order = np.argsort(values)[::-1]
    trace = float(sum(scatter[d][d] for d in range(dims)))
    out = []
    for i, x in ints:
        y = [n * v - s for v, s in zip(x, sums)]
        for c, k in enumerate(order[:4], 1):
            white = float(np.array([v / n for v in y]) @ vectors[:, k]) / math.sqrt(values[k]) if values[k] > 1e-9 * trace else None
            out.append((i, c, n, sum(v * v for v in y), white, max(float(values[k]), 0) / trace if trace else None))
    return out


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], f"vec_id long, embedding {kind}, n int, whitened double").repartition(4)


def agree(got, rows):
    """Component by component, up to the sign of each."""
    want = plain(rows)
    got, want = ([sorted(x, key=lambda r: (str(r[0]), r[1], r[3])) for x in ([tuple(r) for r in got], want)])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        pairs = [(g, w) for g, w in zip(got, want) if g[1] == c]
        sign = next((math.copysign(1, g[4] * w[4]) for g, w in pairs if w[4] and abs(w[4]) > 1e-3), 1)
        for g, w in pairs:
            assert (g[4] is None) == (w[4] is None) and (g[4] is None or abs(g[4] - sign * w[4]) < 1e-7)
            assert g[5] == w[5] or abs(g[5] - w[5]) <= 1e-9


@pytest.mark.parametrize("words", [1, 40, 1 << 22])
def test_against_plain(spark, monkeypatch, words):
    """Also with chunks of 64 vectors."""
    monkeypatch.setattr(whitening, "PLANE_WORDS", words)
    random.seed(words)
    rows = [(i, [random.gauss(0, s) for s in (3, 2, 1, 0.5, 0.1)]) for i in range(300)]
    rows += [(500 + i, [0.5, 0.25, -0.5, 0.0, -0.0]) for i in range(100)]  # a hot vector counts once
    rows += [(0, rows[0][1]), (None, rows[1][1]), (800, None), (801, [1.0, None, 0.0, 0.0, 0.0]), (802, [float("nan")] * 5)]
    rows += [(803, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (804, [3e38, 0.0, 0.0, 0.0, 0.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 4 * 402 and all(r["identity_error"] < 1e-9 for r in got)
    agree([tuple(r)[:6] for r in got], rows)


def test_other_lengths_and_few_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 5.0]), (4, [1.0]), (5, [2.0]), (6, [1.0, 2.0, 3.0]), (7, [])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and {r["component"] for r in got} == {1, 2}
    agree([tuple(r)[:6] for r in got], rows[:3])


def test_nothing_varies(spark):
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = [(i, [float(i), 1.0]) for i in range(5)]
    got = whitening.whiten(table(spark, flat)).collect()
    agree([tuple(r)[:6] for r in got], flat)
    assert all(r["identity_error"] < 1e-9 for r in got)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_empty(spark, kind):
    for rows in ([], [(1, None), (2, [None])], [(1, [])]):
        out = whitening.whiten(table(spark, rows, kind))
        assert out.count() == 0 and out.columns[0] == "vec_id"


def test_sums_past_64_bits(spark):
    """Products near 2^120 are exact; a deviation that does not fit is NULL."""
    rows = [(1, [2.0**52, 1.0]), (2, [-(2.0**52), 0.5]), (3, [2.0**51 + 1, 0.25])]
    model_rows = [[int(256 * v) for v in x] for _, x in rows]
    low, high = ([f(x[d] for x in model_rows) for d in range(2)] for f in (min, max))
    codes = spark.createDataFrame([(c,) for c in whitening.encode(np.array(model_rows, np.int64))], "_x binary")
    bits = [(h - v).bit_length() for v, h in zip(low, high)]
    total, matrix = whitening.cross_products(codes, 2, low, bits)
    shifted = [[v - m for v, m in zip(x, low)] for x in model_rows]
    assert total == [sum(x[d] for x in shifted) for d in range(2)]
    assert matrix == [[sum(x[a] * x[b] for x in shifted) for b in range(2)] for a in range(2)]
    got = whitening.whiten(table(spark, rows, "array<double>")).collect()
    assert all(r["deviation"] is None and r["identity_error"] < 1e-6 for r in got)


def test_codes():
    x = np.array([[0, -1], [127, -128], [128, 0], [-32768, 1], [2**31, 0], [2**63 - 1, -(2**63)]], np.int64)
    codes = whitening.encode(x)
    assert [len(c) for c in codes] == [3, 3, 5, 5, 17, 17] and (whitening.decode(codes, 2) == x).all()


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in data], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    assert len(got) == 4 * len(data) and got[0]["identity_error"] < 1e-9
    deviation = {r[0]: int(((n * v - sums) ** 2).sum()) for r, v in zip(data, x)}
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in got)
    values, vectors = np.linalg.eigh((fit * n - sums).astype(float).T @ (fit * n - sums) / n**3)
    for c in range(4):
        rows = sorted((r["vec_id"], r["whitened"], r["explained"]) for r in got if r["component"] == c + 1)
        want = ((x * n - sums) / n) @ vectors[:, -1 - c] / math.sqrt(values[-1 - c])
        have = np.array([r[1] for r in rows])[np.argsort(np.argsort([r[0] for r in data]))]
        assert min(abs(have - want).max(), abs(have + want).max()) < 1e-8
        assert abs(rows[0][2] - values[-1 - c] / values.sum()) < 1e-9
