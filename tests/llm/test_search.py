"""Top-k, shards and length buckets against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkwell.llm import packing, sharding, topk


def plain_top_k(rows, is_query, k):
    usable = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((n, i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for n, i, v in usable:
        if is_query(i):
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for m, j, w in usable if m != n and len(w) == len(v)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)


@pytest.mark.parametrize("bins", [3, 64])
def test_top_k(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    random.seed(bins)
    rows = [(i, [round(random.uniform(-1, 1), 2) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5]) for i in range(40)]  # ties far beyond k
    rows += [(0, rows[0][1]), (200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf")] * 3)]
    rows += [(None, [1.0, 1.0, 1.0]), (300, [1.0]), (310, [2.0]), (320, []), (330, [])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=5, bins=bins)
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(rows, lambda i: i % 10 == 0, 5)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") == 0, k=5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 256 * 11)]
    for df in (table(spark, rows).where("vec_id > 5"), table(spark, rows[:1])):
        assert topk.top_k(df, F.col("vec_id") == 0).count() == 0


def test_large_components_stay_exact():
    import numpy as np

    big = np.array([[2**40 + 1, -3]], np.int64)
    assert topk.inner_products(big, np.array([[2**20 + 1, 7]], np.int64))[0, 0] == (2**40 + 1) * (2**20 + 1) - 21
    with pytest.raises(OverflowError):
        topk.inner_products(big, np.array([[2**62, 0]], np.int64))


def shards_hold(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for found in by.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= slack + 0.001 * mean, sizes
    return by


def test_shards(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = sharding.shard_documents(documents, shards=7).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode()))
    shards_hold(rows, 7, max(r["size"] for r in rows))


def test_shards_split_hot_texts_and_rows(spark):
    # A third are copies of one text, a third is one repeated row.
    rows = [(i, "a hot text of some length") for i in range(3000)] + [(9, "a hot row")] * 3000
    rows += [(10_000 + i, f"text {i} " + "x" * (i % 90)) for i in range(3000)]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, shard int, size int").repartition(5)
    got = sharding.shard_documents(docs, shards=24).collect()
    assert Counter((r["doc_id"]) for r in got) == Counter(i for i, _ in rows)
    shards_hold(got, 24, 200)


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard_documents(odd, shards=4).collect()
    assert len(got) == odd.count()
    shards_hold(got, 4, 24_100)
    assert sharding.shard_documents(none).count() == 0
    one = sharding.shard_documents(odd.where("doc_id = 5"), shards=24).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def plain_padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= size) - size) for size, n in histogram.items())


@pytest.mark.parametrize("seed", range(6))
def test_buckets_are_optimal(seed):
    random.seed(seed)
    histogram = {random.randint(1, 40): random.randint(1, 50) for _ in range(9)}
    sizes = sorted(histogram)
    for buckets in (1, 2, 3, 20):
        ends = packing.bucket_lengths(histogram, buckets)
        best = min(
            plain_padding(histogram, [*c, sizes[-1]])
            for c in itertools.combinations(sizes[:-1], min(buckets, len(sizes)) - 1)
        )
        assert ends == sorted(set(ends)) and len(ends) <= buckets
        assert plain_padding(histogram, ends) == best


def test_packing_places_every_token_once(odd, none, documents):
    for docs in (odd, documents):
        got = packing.length_buckets(docs, longest=50, buckets=4, budget=300).collect()
        tokens = Counter()
        for r in got:
            tokens[r["doc_id"]] += r["n_tokens"]
        plain = docs.select("doc_id", packing.token_count(F.coalesce("text", F.lit(""))).alias("n")).groupBy("doc_id").agg(F.sum("n"))
        assert tokens == Counter({r[0]: r[1] for r in plain.collect()})
        batches = defaultdict(list)
        for r in got:
            if not r["n_tokens"]:
                assert r["bucket_length"] is r["batch_no"] is r["place"] is None
                continue
            assert r["first_token"] == 50 * r["piece"] and r["n_tokens"] <= r["bucket_length"] <= 50
            batches[r["bucket_length"], r["batch_no"]].append(r["place"])
        last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
        for (bucket, n), places in batches.items():
            room = 300 // bucket
            assert sorted(places) == list(range(len(places)))
            assert len(places) == room if n < last[bucket] else len(places) <= room
    assert packing.length_buckets(none).count() == 0
