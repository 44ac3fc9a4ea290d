"""De-duplication, requests, batching and cost."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.operators import dedup, limits, requests
from inkwell.operators.groups import block_of
from inkwell.sources.sinks import as_json_lines


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx bigint, text string")


def test_dedup_and_expand(spark):
    p = prompts(spark, ["a", "b", "a"])
    groups = {r["first_idx"]: r["copies"] for r in dedup.dedup_groups(p).collect()}
    assert groups == {0: 2, 1: 1}
    assert [(r["idx"], r["text"]) for r in dedup.unique_prompts(p).orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    results = spark.createDataFrame([("0", 1, "old"), ("0", 2, "new")], "custom_id string, seq int, content string")
    got = dedup.in_id_order(dedup.expand_results(p, results)).collect()
    assert [tuple(r) for r in got] == [("0", "new"), ("1", None), ("2", "new")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=40))
def test_expanding_a_dedup_gives_every_prompt_back(spark, small_limits, texts):
    p = prompts(spark, texts)
    results = dedup.unique_prompts(p).select(
        F.col("idx").cast("string").alias("custom_id"), F.lit(0).alias("seq"), F.col("text").alias("content")
    )
    got = dedup.in_id_order(dedup.expand_results(p, results)).collect()
    assert [tuple(r) for r in got] == [(str(i), t) for i, t in enumerate(texts)]
    lists = {}
    for r in dedup.index_lists(p, segment_items=3).orderBy("segment_no").collect():
        assert len(r["items"]) <= 3
        lists.setdefault(r["hash"], []).extend(r["items"])
    assert sorted(lists.values()) == sorted([i for i, t in enumerate(texts) if t == c] for c in set(texts))


def test_ids_sort_as_numbers(spark):
    df = spark.createDataFrame([("10",), ("9",), ("2",)], "custom_id string")
    assert [r[0] for r in dedup.in_id_order(df).collect()] == ["2", "9", "10"]


def plain_size(total, largest):
    if total <= largest:
        return total
    return next((s for s in range(largest, 1000, -500) if total % s < 100), largest)


def test_batch_size(column):
    pairs = [(10, 100), (2500, 5000), (5001, 5000), (12000, 5000), (12345, 5000), (1500, 1000), (0, 5000)]
    got = [column(lambda c: requests.batch_size(c, m), [n], "bigint")[0] for n, m in pairs]
    assert got == [10, 2500, 5000, 4000, 5000, 1000, 0]
    totals = [random.Random(1).randrange(1, 60000) for _ in range(200)]
    for largest in (900, 1200, 5000):
        assert column(lambda c: requests.batch_size(c, largest), totals, "bigint") == [plain_size(t, largest) for t in totals]


def test_batches_cover_the_index_once(spark):
    df = spark.range(2750).select(F.col("id").alias("idx"))
    got = requests.assign_batches(df, max_batch_size=1200).collect()
    assert len({(r["batch_no"], r["custom_id"]) for r in got}) == 2750
    for r in got:
        assert r["start_item"] + int(r["custom_id"]) == r["idx"] < r["end_item"] <= 2750
    ordered = requests.assign_batches_in_order(df.select((F.col("idx") * 7).alias("key")), ["key"], 1200).collect()
    assert {(r["batch_no"], r["custom_id"]) for r in ordered} == {(r["batch_no"], r["custom_id"]) for r in got}


def test_request_records(spark):
    df = spark.createDataFrame([("0", "Hi <b>")], "custom_id string, text string")
    line = as_json_lines(requests.build_requests(df, "O1-pro")).first()[0]
    assert line == (
        '{"custom_id":"0","method":"POST","url":"/v1/chat/completions","body":{"model":"O1-pro","messages":'
        '[{"role":"user","content":"Hi b"}],"max_tokens":1024,"temperature":0.7,"reasoning_effort":"medium",'
        '"response_format":{"type":"json_object"}}}'
    )
    plain = as_json_lines(requests.build_requests(df, "gpt-4", response_format="text")).first()[0]
    assert "reasoning_effort" not in plain and "response_format" not in plain


def usage(spark, rows):
    return spark.createDataFrame(rows, "model string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint")


def test_cost_of_a_million_each(spark):
    row = requests.cost_by_model(usage(spark, [("o1-pro", 10**6, 10**6, 10**6)])).where("is_total = 1").first()
    assert (row["input_cost"], row["output_cost"], row["reasoning_cost"], row["total_cost"]) == (75, 300, 300, 675)


def test_total_is_the_sum_of_its_parts(spark):
    rng = random.Random(3)
    names = ["o1-pro", "O1-Mini", "gpt-4o-mini", "gpt-4", "GPT-3.5-turbo", "other"]
    rows = [(rng.choice(names), rng.randrange(9999), rng.randrange(9999), rng.randrange(99)) for _ in range(400)]
    got = requests.cost_by_model(usage(spark, rows)).collect()
    total = next(r for r in got if r["is_total"])
    parts = [r for r in got if not r["is_total"]]
    assert total["requests"] == 400 and len(parts) == 6
    assert total["total_cost"] == pytest.approx(sum(r["total_cost"] for r in parts), abs=1e-9)
    assert total["total_cost"] == pytest.approx(
        total["input_cost"] + total["output_cost"] + total["reasoning_cost"], abs=1e-9
    )


def test_budget(spark):
    p = prompts(spark, ["one two", "three"])
    row = requests.estimate_batch_cost(p, "gpt-4", 1000, budget=0.06).first()
    assert (row["prompts"], row["total_input_tokens"], row["total_output_tokens"]) == (2, 3, 2000)
    assert row["total_cost"] == pytest.approx(0.060045) and not row["within_budget"]
    assert requests.estimate_batch_cost(p, "gpt-4", 1000, budget=row["total_cost"]).first()["within_budget"]
    assert requests.enforce_budget(p, "gpt-4", 1000, None) is p
    with pytest.raises(requests.BudgetExceeded, match=r"\$0.0600 exceeds budget \$0.06"):
        requests.enforce_budget(p, "gpt-4", 1000, 0.06)


def test_models(spark, column):
    df = spark.createDataFrame([("o1-x",), ("Text-Embedding-3",), ("whisper",), ("o1-x",)], "model string")
    assert {r[0] for r in requests.compatible_models(df).collect()} == {"o1-x", "Text-Embedding-3"}
    none = requests.compatible_models(df.where("model = 'whisper'"))
    assert {r[0] for r in none.collect()} == set(requests.FALLBACK_MODELS)
    assert column(lambda c: requests.resolve_model(c, ["o1-x"]), ["o1-x", "zzz"]) == ["o1-x", "gpt-3.5-turbo"]


@pytest.mark.parametrize("cut", [False, True])
def test_budget_cutoff(spark, cut, request):
    if cut:
        request.getfixturevalue("small_limits")
    df = spark.createDataFrame([("k", i, 3) for i in range(20)], "k string, i int, cost int")
    got = limits.budget_cutoff(df, ["k"], ["i"], "cost", 5, block_of("i")).orderBy("i").collect()
    assert [r["admitted"] for r in got] == [True, True] + [False] * 18
    for free in (0, None):
        assert all(r["admitted"] for r in limits.budget_cutoff(df, ["k"], ["i"], "cost", free, block_of("i")).collect())


def test_rate_usage(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", 59_000), ("2024-01-01 00:00:59", 1_001), ("2024-01-01 00:01:00", 60_000)], "t string, tokens bigint")
    got = limits.rate_usage(df.withColumn("ts", F.col("t").cast("timestamp"))).orderBy("minute").collect()
    assert [(r["tokens"], r["requests"], r["over_limit"]) for r in got] == [(60_001, 2, True), (60_000, 1, False)]


def test_failed_batches(spark):
    batched = requests.assign_batches(spark.range(2750).select(F.col("id").alias("idx")), max_batch_size=1200)
    failures = spark.createDataFrame([(2, "429")], "batch_no bigint, error string")
    assert [tuple(r) for r in requests.failed_batches(batched, failures).collect()] == [(3, 2400, 2750, "429")]


def test_own_prices(spark):
    from decimal import Decimal

    from inkwell.functions.pricing import Price

    own = [Price("mini", Decimal("1"), Decimal("2")), Price("gpt", Decimal("10"), Decimal("20"), Decimal("30"))]
    rows = usage(spark, [("gpt-mini", 10**6, 10**6, 10**6), ("GPT-x", 10**6, 0, 10**6), ("zzz", 5, 5, 5)])
    got = {r["model"]: r["total_cost"] for r in requests.cost_by_model(rows, own, Price("free", Decimal(0), Decimal(0))).collect()}
    assert got == {"gpt-mini": 3.0, "gpt-x": 40.0, "zzz": 0.0, None: 43.0}


def test_submit_reads_texts_twice(spark):
    """Once for the hashes and once for the requests: counts and positions come from the hashes."""
    texts = [(i, f"text {i % 7 if i % 2 else i} é") for i in range(40)] + [(40, None)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        read.add(1)
        return text

    cleaned = spark.createDataFrame(texts, "idx bigint, text string").select("idx", noted.asNondeterministic()("text").alias("text"))
    unique, indices = dedup.unique_with_indices(cleaned)
    batched = requests.assign_batches_in_order(unique.drop("hash"), ["idx"], 1000, ids=F.col("idx"), unique=True, keys=indices)
    got = sorted((r["idx"], r["position"], r["end_item"], r["text"]) for r in batched.collect())
    first = {}
    for i, t in texts[:-1]:
        first.setdefault(t, i)
    want = sorted(first.items(), key=lambda x: x[1])
    assert got == [(i, n, len(want), t) for n, (t, i) in enumerate(want)]
    assert read.value <= 2 * len(texts)
