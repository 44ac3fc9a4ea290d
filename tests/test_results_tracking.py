"""Result lines, the batch table and its reports."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import results, tracking
from inkwell.schemas import BATCH, ERROR_LINE


def lines(spark, records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")


def answer(content, role="assistant"):
    return [{"message": {"role": role, "content": content}}]


def test_flatten_results(spark):
    records = [
        {
            "custom_id": "0", "status": "ok", "created_at": "2024", "model": "gpt-4",
            "usage": {"prompt_tokens": 1, "completion_tokens": 2, "reasoning_tokens": 3, "total_tokens": 6},
            "choices": answer("first") + answer("second"),
        },
        {"custom_id": "1"},
        "   ",
        {"custom_id": "2", "choices": [], "content": "parsed before"},
        {"custom_id": "3", "choices": [{"message": {"content": None}}]},
    ]
    got = [tuple(r) for r in results.flatten_results(results.parse_lines(lines(spark, records))).collect()]
    assert got == [
        ("0", "ok", "2024", 1, 2, 3, 6, "gpt-4", "first", "assistant"),
        ("1", "", "", 0, 0, 0, 0, "", "", None),
        ("2", "", "", 0, 0, 0, 0, "", "parsed before", None),
        ("3", "", "", 0, 0, 0, 0, "", "", ""),
    ]


def test_a_bad_line_raises(spark):
    with pytest.raises(Exception, match="(?i)malformed"):
        results.parse_lines(lines(spark, ["{bad"])).collect()


def test_parse_result_lines(spark):
    good = json.dumps({"summary": "short", "key_points": ["a"]})
    df = lines(spark, [{"custom_id": "0", "choices": answer(good)}, {"custom_id": "1", "choices": answer("raw")}])
    assert [r["content"] for r in results.parse_result_lines(df).collect()] == ["short", "raw"]
    assert results.parse_result_lines(df, F.lit("in_progress")).count() == 0


def test_errors_and_outcomes(spark):
    errors = results.parse_lines(
        lines(spark, [{"custom_id": "9", "error": {"type": "t", "message": "m"}}, {"error": {}}, {}]), ERROR_LINE
    )
    assert [tuple(r) for r in results.flatten_errors(errors).collect()] == [
        ("9", "t", "m"), ("Unknown", "Unknown", "Unknown"), ("Unknown", "Unknown", "Unknown"),
    ]
    both = results.outcomes(results.parse_lines(lines(spark, [{"custom_id": "1"}])), errors)
    assert both.groupBy("kind").count().orderBy("kind").collect() == [("error", 3), ("result", 1)]


def batches(spark, rows):
    """Rows of id, status, created_at, model."""
    return spark.createDataFrame(
        [(i, s, c, m, 0, None, {}) for i, s, c, m in rows], BATCH
    )


def test_batch_stats(spark):
    df = batches(spark, [(str(i), s, None, None) for i, s in enumerate(["completed", "failed", "expired", "in_progress", "detected"])])
    assert tuple(tracking.batch_stats(df).first()) == (5, 1, 1, 1, 2)


def flat(spark, rows):
    return spark.createDataFrame(
        rows, "batch_id string, custom_id string, model string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint"
    )


def test_summary_and_its_text(spark):
    df = batches(spark, [("a", "completed", "2024-01-01T00:00:00Z", "gpt-4"), ("b", None, None, None)])
    done = flat(spark, [("a", str(i), "gpt-4", 1000, 100, 10) for i in range(3)])
    errors = spark.createDataFrame([("a", "3")], "batch_id string, custom_id string")
    summary = tracking.batch_summary(df, done, errors)
    rows = {r["id"]: r for r in summary.collect()}
    assert rows["a"]["success_rate"] == 75.0 and rows["b"]["success_rate"] == 0.0
    assert rows["a"]["summed_tokens"] == 3330
    texts = {r["id"]: r["text"] for r in tracking.summary_text(summary).collect()}
    assert texts["a"] == (
        "Status: completed\nCreated: 2024-01-01 00:00:00\nModel: gpt-4\nResults: 3\nErrors: 1\nSuccess Rate: 75.0%\n"
        "Input Tokens: 3,000\nOutput Tokens: 300\nTotal Tokens: 3,330\nEstimated Cost: $0.0540"
    )
    assert texts["b"] == "Status: Unknown\nCreated: N/A\nModel: Unknown\nResults: 0\nErrors: 0\nSuccess Rate: 0.0%"


def test_listing_filters_and_shares(spark):
    df = batches(spark, [("a", "completed", "t", "m1"), ("b", "completed", "t", "m2"), ("c", "validating", None, None)])
    done = flat(spark, [("a", "0", "m1", 1, 1, 1)] * 3 + [("b", "0", "m2", 1, 1, 1)] + [("c", "0", "x", 5, 5, 5)])
    errors = spark.createDataFrame([("c", "3")], "batch_id string, custom_id string")
    listed = {r["id"]: tuple(r)[1:] for r in tracking.batch_listing(df, done, errors).collect()}
    assert listed == {"a": ("completed", "t", "m1", 0, 3, 0), "b": ("completed", "t", "m2", 0, 1, 0),
                      "c": ("validating", "Unknown", "Unknown", 0, 1, 1)}
    shares = {r["model"]: (r["requests"], r["share"]) for r in tracking.requests_by_model(df, done).collect()}
    assert shares == {"m1": (3, 0.75), "m2": (1, 0.25)}
    cost = {r["model"]: r for r in tracking.allocated_cost(df, done).collect()}
    assert cost["m1"]["input_tokens"] == 3.0 and cost["m2"]["output_tokens"] == 1.0
    assert tracking.filter_batches(df).count() == 3
    assert [r["id"] for r in tracking.filter_batches(df, ["completed"], ["m2"]).collect()] == ["b"]
    assert [r["id"] for r in tracking.active_batches(df).collect()] == ["c"]
    assert tracking.terminal_batches(df).count() == 2
    assert {r["id"] for r in tracking.completed_with_results(df, done).collect()} == {"a", "b"}
    assert tracking.batch_by_id(df, "zz").count() == 0
    assert {r[0] for r in tracking.distinct_models(df).collect()} == {"m1", "m2", "Unknown"}


def test_updates(spark):
    df = batches(spark, [("a", "validating", "t", "m1"), ("b", "completed", "t", "m2")])
    changes = spark.createDataFrame([("a", "failed", 2), ("a", "in_progress", 1), ("zz", "failed", 1)], "id string, status string, seq int")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = {r["id"]: (r["status"], r["last_updated"]) for r in tracking.update_batches(df, changes, ["seq"], now).collect()}
    assert got == {"a": ("failed", "2024-02-01T00:00:00"), "b": ("completed", None)}


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "batches")
    assert tracking.read_batches(spark, path).count() == 0
    first = batches(spark, [(f"b{i}", "validating", "t", "m") for i in range(200)])
    tracking.store_upsert(first, path, ["created_at"])
    assert tracking.read_batches(spark, path).count() == 200
    tracking.store_upsert(batches(spark, [("b7", "completed", "t", "m"), ("new", "failed", "t", "m")]), path, ["created_at"])
    stored = {r["id"]: r["status"] for r in tracking.read_batches(spark, path).collect()}
    assert len(stored) == 201 and stored["b7"] == "completed" and stored["new"] == "failed" and stored["b8"] == "validating"
    one = tracking.read_batches(spark, path, "b7")
    assert [r["status"] for r in one.collect()] == ["completed"] and tracking.read_batches(spark, path, "zz").count() == 0
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    everything = tracking.read_batches(spark, path).select("id")
    tracking.store_delete(everything.where("id <> 'b7'"), path)
    assert [r["id"] for r in tracking.read_batches(spark, path).collect()] == ["b7"]
    tracking.store_delete(everything.limit(0), path)
    tracking.store_upsert(first.limit(0), path, ["created_at"])
    assert tracking.read_batches(spark, path).count() == 1


def test_ids_and_pruning(spark):
    df = batches(spark, [("b", "x", "2024-01-01T00:00:00", None), ("a", "x", "2023-12-31T23:59:59", None), ("c", "x", "soon", None)])
    other = spark.createDataFrame([("a",), ("d",)], "id string")
    assert [r[0] for r in tracking.all_batch_ids(df, other).collect()] == ["a", "b", "c", "d"]
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert {r["id"] for r in tracking.prune_batches(df, as_of).collect()} == {"b", "c"}
    assert {r["id"] for r in tracking.old_batches(df, as_of).collect()} == {"a"}


@pytest.mark.parametrize("cut", [False, True])
def test_status_changes(spark, cut, request):
    if cut:
        request.getfixturevalue("small_limits")
    seen = spark.createDataFrame(
        [("a", i, s) for i, s in enumerate(["validating", "in_progress", "in_progress", "completed"])], "id string, ts int, status string"
    )
    got = tracking.status_changes(seen, F.floor(F.col("ts") / 2)).orderBy("ts").collect()
    assert [(r["ts"], r["status"], r["previous"]) for r in got] == [
        (0, "validating", None), (1, "in_progress", "validating"), (3, "completed", "in_progress"),
    ]


def test_poll_timeouts(spark):
    rows = [("slow", "2024-01-01 00:00:00", "in_progress"), ("done", "2024-01-01 00:00:00", "completed"),
            ("new", "2024-01-01 23:00:00", "in_progress"), ("lost", "2024-01-01 00:00:00", None)]
    seen = spark.createDataFrame(rows, "id string, t string, status string").withColumn("ts", F.col("t").cast("timestamp"))
    as_of = F.lit("2024-01-02 00:00:01").cast("timestamp")
    got = {r["id"]: (r["final_status"], r["timed_out"]) for r in tracking.poll_timeouts(seen, as_of).collect()}
    assert got == {"slow": ("in_progress", True), "done": ("completed", False), "new": ("in_progress", False), "lost": ("unknown", True)}
