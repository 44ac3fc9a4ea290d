"""The Jaccard join against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import jaccard


def plain_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_join(rows, percent=75):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(key, len(sets[i]), least.get(top(i), key)) for i, (key, _) in enumerate(rows)]


def edited(words, rate):
    return [w if random.random() > rate else f"edit{random.randrange(10**6)}" for w in words]


def made(seed, groups, copies, rates, length):
    random.seed(seed)
    line = [f"line{i}" for i in range(9)]
    passage = [f"passage{i}" for i in range(40)]
    rows = []
    for _ in range(groups):
        base = [f"w{random.randrange(10**5)}" for _ in range(random.choice(length))]
        for _ in range(random.choice(copies)):
            words = edited(base, random.choice(rates))
            if random.random() < 0.5:
                words = line + words
            if random.random() < 0.3:
                words += passage
            rows.append(" ".join(words))
    random.shuffle(rows)
    return list(enumerate(rows, 1))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(4)


def check(spark, rows, **more):
    got = sorted((tuple(r) for r in jaccard.link_documents(frame(spark, rows), **more).collect()), key=repr)
    assert got == sorted(plain_join(rows, more.get("percent", 75)), key=repr)


def test_groups_and_passages(spark):
    check(spark, made(1, 60, [1, 1, 2, 5], [0, 0.005, 0.02, 0.05], [8, 30, 120, 400]))


@pytest.mark.parametrize("seed", [2])
def test_large_group_goes_through_pivots(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", 150)
    monkeypatch.setattr(jaccard, "PIVOT_PAIRS", 200)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    # Copies around the threshold: some link directly, some through others, some not at all.
    check(spark, made(seed, 2, [50], [0.01, 0.03, 0.05, 0.08], [60, 90]))


def test_other_threshold(spark):
    check(spark, made(4, 20, [1, 4], [0.01, 0.05, 0.1], [40, 90]), percent=50)


def test_short_odd_and_repeated_rows(spark, odd, none):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "a b c d"), (8, "a b c d e"), (9, "É b"), (10, "é b")]
    rows += [(4, "a"), (None, "a"), (None, None), (None, "alone and without a key"), (11, "a b c d e f"), (2, "")]
    check(spark, rows)
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard.link_documents(none).count() == 0
    check(spark, [(1, "one two three four five six"), (2, "quite another text of other words")])


def test_sets_with_one_number_are_told_apart(spark, monkeypatch):
    rows = made(6, 5, [1], [0], [20, 40])
    df = frame(spark, rows)
    first = jaccard.first_shingles

    def clashing(docs, common, shared, salt, percent):
        out = first(docs, common, shared, salt, percent)
        from pyspark.sql import functions as F

        return out.withColumn("node", F.lit(1).cast("long")) if salt == 0 else out

    monkeypatch.setattr(jaccard, "first_shingles", clashing)
    got = sorted(tuple(r) for r in jaccard.link_documents(df).collect())
    assert got == sorted(plain_join(rows))


def test_common_order_is_a_bijection():
    import numpy as np

    items = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    bits = (items >> np.uint64(32)).astype(np.int64)
    common = np.sort(bits[::7] << 8 | 9)
    got = jaccard.ordered(items, common)
    assert sorted(got.tolist()) == items.tolist()
    assert set(got[-len(common):].tolist()) == set(items[::7].tolist())


def test_sets_of_rows_at_the_ends_of_the_bitmap(spark):
    keys = [0, 1, jaccard.BITMAP - 1, jaccard.BITMAP, -jaccard.BITMAP, 32767, 32768, 5]
    docs = spark.createDataFrame([(k, f"words of the text number {n} alone") for n, k in enumerate(keys)], "k long, text string")
    for wanted in (keys, [0], [jaccard.BITMAP - 1]):
        texts = [r["text"] for r in docs.collect() if r["k"] % jaccard.BITMAP in {k % jaccard.BITMAP for k in wanted}]
        nodes = {int(jaccard.node_of(jaccard.shingles(t), 7)[0]) for t in texts}
        needed = spark.createDataFrame([(k, 0) for k in wanted], "k long, node long")
        assert {r["node"] for r in jaccard.sets_of(docs, needed, 7).collect()} == nodes


def test_texts_with_common_passages_have_no_cells(spark, monkeypatch):
    # A passage of three texts each: such texts were copied to its cells, and all of them were one region.
    random.seed(8)
    passages = [" ".join(f"p{i}x{k}" for k in range(12)) for i in range(20)]
    rows = []
    for i in range(60):
        words = [f"w{random.randrange(10**6)}" for _ in range(70)]
        rows.append((i, " ".join([passages[i % 20], *words, passages[(i * 7 + 1) % 20]])))
    seen, first = [], jaccard.first_shingles

    def spied(*args):
        seen.append(first(*args))
        return seen[-1]

    monkeypatch.setattr(jaccard, "first_shingles", spied)
    check(spark, rows)
    assert seen[0].where("size(first) > 0").count() == 0


def test_tables_of_a_group_grow_with_its_members(spark, monkeypatch):
    # Copies around the threshold, 70 sets: their pairs were rows.
    rows, sizes, kept = made(9, 1, [70], [0.02, 0.04, 0.05], [90]), [], jaccard.written

    def spied(df, label):
        out = kept(df, label)
        sizes.append((out.count() if label != "shingle-counts" else 0, label))
        return out

    monkeypatch.setattr(jaccard, "written", spied)
    check(spark, rows)
    assert max(sizes)[0] <= 2 * len(rows), max(sizes)


def long_texts(n):
    return [" ".join(f"{i}w{j}" for j in range(20_000)) for i in range(n)]


def test_slices_are_bounded_by_bytes_too():
    texts = [*long_texts(100), None, "", *["a b"] * 1200, "x " * 5_000_000, "c d"]
    got = [s.column("text").to_pylist() for s in jaccard.slices([pa.record_batch({"text": texts}), pa.record_batch({"text": pa.array([], pa.string())})])]
    assert [t for part in got for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 4 << 20 for part in got) and max(map(len, got)) == jaccard.SLICE


def test_shingles_of_long_texts_are_counted_in_bounded_memory():
    texts = long_texts(128)
    texts[1::2] = texts[::2]
    batch = pa.record_batch({"text": texts})
    tracemalloc.start()
    # Counted text by text below.
    times, most = {}, 0
    for part in jaccard.dealt([batch], 20):
        for r, data, again, more in zip(*(part.column(c).to_pylist() for c in ("range", "data", "again", "times"))):
            data, again, more = (np.frombuffer(b, np.uint32) for b in (data, again, more))
            n = np.ones(len(data), np.int64)
            n[np.searchsorted(data, again)] += more
            if r == 7:
                for v, k in zip(data.tolist(), n.tolist()):
                    times[v] = times.get(v, 0) + k
        most, _ = max(most, tracemalloc.get_traced_memory()[1]), tracemalloc.reset_peak()
    tracemalloc.stop()
    want = {}
    for text in texts:
        bits = jaccard.shingles(text) >> np.uint64(20)
        for v in (bits[bits >> np.uint64(32) == 7] & np.uint64(0xFFFFFFFF)).tolist():
            want[v] = want.get(v, 0) + 1
    assert times == want and len(want) > 100
    assert most < 120 << 20
