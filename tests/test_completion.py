"""Completions with a fake service."""

import os
import time
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from inkwell.operators.completion import (
    CompletionError,
    complete_in_waves,
    complete_into,
    document_responses,
    map_completions,
    request_tokens,
)


def flaky():
    """Fails twice on prompts with 'busy', always on 'bad' and 'broken'."""
    tries = {}

    def complete(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if "busy" in prompt and tries[prompt] < 3:
            raise CompletionError("slow down", 429)
        if "down" in prompt:
            raise CompletionError("no service", 503)
        if "bad" in prompt:
            raise CompletionError("bad request", 400)
        if "broken" in prompt:
            raise OSError("socket closed")
        return {"content": prompt.upper(), "id": f"id-{prompt}"}

    return complete


def test_every_prompt_ends_as_a_row(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["ok", "busy", "bad", "broken", "down"])], "k int, prompt string")
    got = {r["prompt"]: r for r in map_completions(df, flaky, base_delay=0.0, partitions=2).collect()}
    assert (got["ok"]["response"], got["ok"]["id"], got["ok"]["success"], got["ok"]["status_code"]) == ("OK", "id-ok", True, 200)
    assert (got["busy"]["response"], got["busy"]["attempts"]) == ("BUSY", 3)
    assert (got["bad"]["error"], got["bad"]["status_code"], got["bad"]["attempts"]) == ("bad request", 400, 1)
    assert (got["broken"]["success"], got["broken"]["status_code"], got["broken"]["attempts"]) == (False, None, 1)
    assert (got["down"]["success"], got["down"]["status_code"], got["down"]["attempts"]) == (False, 503, 4)


def test_document_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y"), (3, "bad q")], "doc_id bigint, text string")

    for kept in (None, str(tmp_path / "answers")):
        got = document_responses(df, flaky, 3, 1, store=kept, base_delay=0.0)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "A B C\nC D E\nE F G\nG", 2: "X Y", 3: ""}
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 6


def counting(folder, limit=None):
    """Leaves a file per call; a worker that finds ``limit`` of them dies before it starts."""

    def factory():
        if limit is not None and len(os.listdir(folder)) >= limit:
            raise RuntimeError("the run stops here")

        def complete(prompt):
            with open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w"):
                pass
            if prompt == "p3":
                raise CompletionError("bad", 400)
            return {"content": prompt.upper(), "id": prompt}

        return complete

    return factory


def test_a_stopped_run_goes_on_without_repeating_calls(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    prompts = spark.createDataFrame([("b", str(i), f"p{i}") for i in range(60)], "batch_id string, custom_id string, prompt string")
    with pytest.raises(Exception, match="the run stops here"):
        complete_into(prompts, store, counting(str(calls), 20), waves=6, partitions=1)
    half = len(os.listdir(calls))
    assert 20 <= half < 60
    got = complete_into(prompts, store, counting(str(calls)), waves=6, partitions=1)
    assert {r["custom_id"]: r["response"] for r in got.collect()} == {str(i): None if i == 3 else f"P{i}" for i in range(60)}
    assert sorted(n.split("-")[0] for n in os.listdir(calls)) == sorted(f"p{i}" for i in range(60))
    # Failures are called again only where asked for.
    complete_into(prompts, store, counting(str(calls)), waves=2)
    assert len(os.listdir(calls)) == 60
    complete_into(prompts, store, counting(str(calls)), waves=2, again=~F.col("success"))
    assert sorted(n.split("-")[0] for n in os.listdir(calls)).count("p3") == 2


def test_several_calls_are_open_at_once(spark):
    def slow():
        def complete(prompt):
            time.sleep(0.3)
            return {"content": prompt, "id": None}

        return complete

    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "k int, prompt string")
    map_completions(df.limit(1), slow, partitions=1).collect()
    start = time.perf_counter()
    got = map_completions(df, slow, partitions=1, in_flight=10).orderBy("k").collect()
    assert [r["response"] for r in got] == [f"p{i}" for i in range(10)]
    assert time.perf_counter() - start < 2.5


def test_request_tokens(column):
    assert column(lambda c: request_tokens(c, 10), ["a b c", ""]) == [13, 10]
    assert column(lambda c: request_tokens(F.col("v"), 0), ["x"]) == [1]


def paid():
    return dict(cost=F.when(F.col("success"), F.length("response") * 0.01).otherwise(0), most=F.lit(0.05))


def some(spark, n, first=0):
    return spark.createDataFrame([("b", str(i), f"p{i}") for i in range(first, first + n)], "batch_id string, custom_id string, prompt string")


def called(folder):
    return sorted(n.split("-")[0] for n in os.listdir(folder))


def test_waves_go_on_after_a_stop_without_repeating_calls(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    prompts = some(spark, 60).coalesce(1)
    with pytest.raises(Exception, match="the run stops here"):
        complete_in_waves(prompts, store, counting(str(calls), 20), wave_size=10, partitions=1)
    half = len(os.listdir(calls))
    assert 20 <= half < 60
    done = complete_in_waves(prompts, store, counting(str(calls)), wave_size=10, partitions=1)
    assert {r["custom_id"]: r["response"] for r in done.outcomes.collect()} == {str(i): None if i == 3 else f"P{i}" for i in range(60)}
    assert called(calls) == sorted(f"p{i}" for i in range(60)) and not done.stopped
    # Once more: nothing is called; prompts that come in addition are.
    complete_in_waves(prompts, store, counting(str(calls)), wave_size=10)
    assert len(os.listdir(calls)) == 60
    more = complete_in_waves(prompts.union(some(spark, 5, 60)), store, counting(str(calls)), wave_size=10)
    assert called(calls) == sorted(f"p{i}" for i in range(65)) and more.outcomes.count() == 65


def test_spending_stops_at_the_limit_and_goes_on_with_a_larger_one(spark, tmp_path):
    """A prompt costs 0.02 or 0.03 and at most 0.05; the failing one nothing."""
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    prompts = some(spark, 40).coalesce(1)
    done = complete_in_waves(prompts, store, counting(str(calls)), wave_size=15, budget=0.5, **paid())
    assert done.stopped and Decimal("0.5") <= done.spent <= Decimal("0.55")
    assert done.spent == sum((Decimal(len(r["response"])) / 100 for r in done.outcomes.collect() if r["success"]), Decimal(0))
    before = len(os.listdir(calls))
    assert before == done.outcomes.count() < 40
    again = complete_in_waves(prompts, store, counting(str(calls)), wave_size=15, budget=0.5, **paid())
    assert again.stopped and len(os.listdir(calls)) == before
    rest = complete_in_waves(prompts, store, counting(str(calls)), wave_size=15, budget=100, **paid())
    assert not rest.stopped and called(calls) == sorted(f"p{i}" for i in range(40)) and rest.outcomes.count() == 40


def test_without_a_known_most_calls_go_one_by_one_near_the_limit(spark, tmp_path):
    done = complete_in_waves(
        some(spark, 6), str(tmp_path / "store"), flaky, budget=0.05, cost=F.lit(0.02), base_delay=0.0
    )
    assert done.stopped and done.spent == Decimal("0.06") and done.outcomes.count() == 3


@pytest.mark.parametrize("rows", [[("b", "1", "x"), ("b", "1", "y")], [("b", None, "x")]])
def test_keys_that_do_not_tell_prompts_apart_are_refused(spark, tmp_path, rows):
    prompts = spark.createDataFrame(rows, "batch_id string, custom_id string, prompt string")
    with pytest.raises(ValueError, match="not NULL and differ"):
        complete_in_waves(prompts, str(tmp_path / "store"), flaky)
    assert complete_in_waves(prompts.limit(0), str(tmp_path / "none"), flaky).outcomes.count() == 0


def test_documents_are_cut_up_once(spark, tmp_path):
    cut = tmp_path / "cut"
    cut.mkdir()
    df = spark.createDataFrame([(i, "a b c d e f g") for i in range(6)], "doc_id bigint, text string").coalesce(1)

    @F.udf("string")
    def noted(text):
        with open(f"{cut}/{uuid.uuid4().hex}", "w"):
            pass
        return text

    got = document_responses(df.withColumn("text", noted.asNondeterministic()("text")), flaky, 3, 1, wave_size=2, base_delay=0.0)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: "A B C\nC D E\nE F G\nG" for i in range(6)}
    assert len(os.listdir(cut)) == 6


def test_many_prompts_are_a_bounded_number_of_waves(spark, tmp_path, monkeypatch):
    """And what a task of a wave has done is kept, so a stop inside one repeats only what was open."""
    from inkwell.operators import completion

    monkeypatch.setattr(completion, "WAVE", 5)
    monkeypatch.setattr(completion, "WAVES", 3)
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    prompts = some(spark, 60).coalesce(1)
    with pytest.raises(Exception, match="the run stops here"):
        complete_in_waves(prompts, store, counting(str(calls), 12))
    half = len(os.listdir(calls))
    assert spark.read.parquet(f"{store}/epoch=0").count() > 0
    done = complete_in_waves(prompts, store, counting(str(calls)))
    # One more for the files of the second run.
    assert done.outcomes.count() == 60 and len([n for n in os.listdir(store) if n.startswith("epoch=")]) <= 4
    assert set(called(calls)) == {f"p{i}" for i in range(60)}
    assert len(os.listdir(calls)) < 60 + half
