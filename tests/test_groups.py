"""Ordered work in groups: every answer must be the same whether a group is cut or not."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import groups
from tests.plan_nodes import columns, exchanges, scans


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(12)}", i, rng.randrange(9), rng.choice("abc")) for i in range(300)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o bigint, v bigint, s string")


def plain(rows):
    w = Window.partitionBy("k").orderBy("o")
    return rows.select(
        "k", "o", "v", "s",
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.lag("s").over(w).alias("prev"),
    )


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("cut", [False, True])
def test_running_work_equals_plain_windows(rows, cut, request):
    if cut:
        request.getfixturevalue("small_limits")
    want = plain(rows)
    block = groups.block_of("o")
    same(groups.running_before(rows, ["k"], ["o"], F.col("v"), block, "x"), want.select("k", "o", "v", "s", "before"))
    same(groups.position_in_group(rows, ["k"], ["o"], block, "x"), want.select("k", "o", "v", "s", "pos"))
    same(groups.previous_in_group(rows, ["k"], ["o"], "s", block, "x"), want.select("k", "o", "v", "s", "prev"))


@pytest.mark.parametrize("size", [7, 1_000_000])
def test_segments_hold_the_whole_group_in_order(rows, small_limits, size):
    got = groups.ordered_text(rows, ["k"], ["o"], F.col("s"), "-", groups.block_of("o"), size).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r["k"], r["segment_no"])):
        whole.setdefault(r["k"], []).append(r["text"])
        assert len(r["text"]) <= size + 2
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        want.setdefault(r["k"], []).append(r["s"])
    assert {k: "-".join(v) for k, v in whole.items()} == {k: "-".join(v) for k, v in want.items()}
    if size > 1000:
        assert len(got) == len(want)


def test_global_group(rows, small_limits):
    got = groups.running_before(rows, [], ["o"], F.lit(1), groups.block_of("o"), "n")
    assert [r["n"] for r in got.orderBy("o").collect()] == list(range(300))


def test_null_pieces_keep_their_place(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c")], "k int, o int, s string")
    assert groups.ordered_text(df, ["k"], ["o"], F.col("s"), "\n", groups.block_of("o")).first()["text"] == "a\n\nc"


def test_dense_index(spark):
    data = [(7 if i % 3 == 0 else i // 10, i) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b int").repartition(5)
    got = groups.dense_index(df, ["a", "b"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(500))
    assert [(r["a"], r["b"]) for r in got] == sorted(data)


def test_heavy_keys_are_few(spark, monkeypatch):
    monkeypatch.setattr(groups, "HEAVY_FLOOR", 10)
    counts = spark.createDataFrame([("hot", 1000), ("b", 10), ("c", 11)], "k string, n bigint")
    assert {(r["k"], r["_fan"]) for r in groups.heavy_keys(counts, ["k"], "n").collect()} == {("hot", 100), ("c", 2)}


@pytest.mark.parametrize("cut", [False, True])
def test_join_to_one(spark, rows, cut, request):
    if cut:
        request.getfixturevalue("small_limits")
    one = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    same(groups.join_to_one(rows, one, ["k"], counts, "n"), rows.join(one, ["k"], "left").select("k", "o", "v", "s", "w"))


def test_latest_by(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "id string, seq int, s string")
    assert sorted(map(tuple, groups.latest_by(df, "id", ["seq"]).collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_null_keys_are_a_group_of_their_own(spark, small_limits):
    data = [(None if i % 2 else "a", i, "xy"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(data, "k string, o int, s string")
    got = groups.ordered_text(df, ["k"], ["o"], F.col("s"), "", groups.block_of("o"), facts={"n": F.lit(1)}).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 0, 15, "x" * 15, 15), (None, 0, 15, "y" * 15, 15)]


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("size", [5, 1_000_000])
def test_facts_marks_and_absent_items(spark, rows, cut, size, request):
    if cut:
        request.getfixturevalue("small_limits")
    item = F.when(F.col("s") != "a", F.col("s"))
    got = groups.ordered_text(
        rows, ["k"], ["o"], item, "", groups.block_of("o"), size, facts={"v": F.col("v"), "n": F.lit(1)}, skip_null=True,
        mark=(F.col("s") == "b").cast("int"), prefix=lambda before: F.concat(F.lit("<"), before.cast("string"), F.lit(">")),
    )
    want, facts = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        text, marks = want.get(r["k"], ("", 0))
        want[r["k"]] = (text if r["s"] == "a" else f"{text}<{marks}>{r['s']}", marks + (r["s"] == "b"))
        v, n = facts.get(r["k"], (0, 0))
        facts[r["k"]] = (v + r["v"], n + 1)
    whole = {}
    for r in sorted(got.collect(), key=lambda r: (r["k"], r["segment_no"])):
        whole[r["k"]] = whole.get(r["k"], "") + r["text"]
        assert (r["v"], r["n"]) == facts[r["k"]]
    assert whole == {k: text for k, (text, _) in want.items()}


def test_segments_do_not_depend_on_blocks(rows, monkeypatch):
    def run():
        return sorted(map(tuple, groups.ordered_text(rows, ["k"], ["o"], F.col("s"), "-", groups.block_of("o"), 9).collect()))

    want = run()
    monkeypatch.setattr(groups, "HEAVY_FLOOR", 2)
    for span in (1, 4, 50):
        monkeypatch.setattr(groups, "BLOCK_SPAN", span)
        assert run() == want


@pytest.mark.parametrize("cut", [False, True])
def test_texts_move_once(spark, tmp_path, rows, cut, request):
    """One exchange of items; of groups that are cut only border segments move again, as collected lists."""
    if cut:
        request.getfixturevalue("small_limits")
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    texts = lambda: groups.ordered_text(stored, ["k"], ["o"], F.col("s"), "-", groups.block_of("o"))
    assert len(exchanges(texts(), "_item")) == 1
    assert len(exchanges(texts(), "buf")) <= (1 if cut else 0)
    assert len(scans(texts(), "s")) <= 2


@pytest.mark.parametrize("small,bits", [(200_000, 27), (0, 27), (0, 16), (0, 4)])
def test_without(spark, tmp_path, monkeypatch, request, small, bits):
    """The list as it is, as a filter, and as a filter that is full."""
    monkeypatch.setattr(groups, "SMALL_LIST", small)
    monkeypatch.setattr(groups, "MOST_FILTER_BITS", bits)
    data = [(i, f"text {i}") for i in range(3000)] + [(5, "other"), (None, "none"), (7, "text 7")]
    spark.createDataFrame(data, "idx long, text string").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
        request.addfinalizer(lambda name=name: spark.conf.unset(name))
    listed = [(i, f"text {i}"[::-1]) for i in range(0, 3000, 7)] + [(5, "text 5"[::-1]), (9, "not the same"), (10**9, "x")]
    gone = spark.createDataFrame(listed, "idx long, back string")
    got = groups.without(rows, gone, ["idx"], {"back": F.reverse("text")})
    out = {i for i, _ in listed if i < 10**6} - {9}
    want = [(i, t) for i, t in data if not (i in out and t == f"text {i}")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    moved = [n for n in exchanges(got, "text") if "text" in columns(n)]
    assert len(moved) == (0 if small else 1)
    if bits > 8 and not small:
        rows_moved = moved[0].metrics().apply("shuffleRecordsWritten").value()
        assert len(out) <= rows_moved < 700
    assert groups.without(rows, gone.limit(0), ["idx"], {"back": F.reverse("text")}).count() == len(data)
    assert groups.without(rows, gone.select("idx"), ["idx"]).count() == len([1 for i, _ in data if i not in out | {9}])


@pytest.mark.parametrize("stride,quantiles", [(64, 4096), (4, 64), (2, 16)])
def test_blocks_of_equal_depth(spark, monkeypatch, stride, quantiles):
    """One id with a third of all rows inside one minute is spread over many tasks; answers are those of plain windows."""
    monkeypatch.setattr(groups, "HEAVY_FLOOR", 100)
    monkeypatch.setattr(groups, "STRIDE", stride)
    monkeypatch.setattr(groups, "QUANTILES", quantiles)
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.randrange(60_000_000) if i % 3 == 0 else i * 10**9, i, rng.choice("abc")) for i in range(9000)]
    rows = spark.createDataFrame(data, "k string, t bigint, o bigint, s string").select(
        "k", F.timestamp_micros("t").alias("t"), "o", F.col("o").alias("v"), "s"
    ).repartition(6)
    blocks = groups._blocked(rows, ["k"], None, ["t", "o"]).groupBy("k", "_heavy", "_block").count().collect()
    sizes = [r["count"] for r in blocks if r["k"] == "hot"]
    assert sum(sizes) == 3000 and all(r["_heavy"] == (r["k"] in ("hot",) or r["_heavy"]) for r in blocks)
    assert len(sizes) >= min(quantiles, 30) * 0.8 and max(sizes) <= 3 * 3000 / min(quantiles, 30)
    w = Window.partitionBy("k").orderBy("t", "o")
    want = rows.select("k", "o", F.lag("s").over(w).alias("x"))
    same(groups.previous_in_group(rows, ["k"], ["t", "o"], "s", None, "x").select("k", "o", "x"), want)
    want = rows.select("k", "o", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("x"))
    same(groups.running_before(rows, ["k"], ["t", "o"], F.col("v"), None, "x").select("k", "o", "x"), want)
    every = Window.orderBy("t", "o")
    got = groups.position_in_group(rows, [], ["t", "o"], None, "x").select("o", "x")
    same(got, rows.select("o", (F.row_number().over(every) - 1).alias("x")))


def test_the_tasks_of_a_hot_id_are_of_like_size(spark, monkeypatch):
    monkeypatch.setattr(groups, "HEAVY_FLOOR", 100)
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("o"),
        F.lit("s").alias("s"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = groups.previous_in_group(rows, ["k"], ["o"], "s", None, "x").select("k", F.spark_partition_id().alias("p"))
        sizes = sorted(r["count"] for r in got.where("k = 'hot'").groupBy("p").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3000 and len(sizes) == 8 and sizes[-1] < 1000
