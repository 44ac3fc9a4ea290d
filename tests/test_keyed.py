"""Status in event-time order as keyed state: any order of files within the delay gives what the batch gives."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkwell.operators.tracking import poll_timeouts, status_changes
from inkwell.streaming.keyed import PROVIDER, keyed_status, last_summaries, read_keyed, rocks_state, write_keyed

START = datetime(2024, 1, 1)
SEEN = "id string, status string, ts timestamp, sequence long"


def drop(folder, name, rows):
    """``(id, status, minute, sequence)``; files are taken in the order in which they are written."""
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(
        json.dumps({"id": i, "status": s, "ts": (START + timedelta(minutes=m)).isoformat(), "sequence": n}) + "\n" for i, s, m, n in rows
    ))
    time.sleep(0.02)


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    write_keyed(keyed_status(stream, "3 hours", 1800, **options), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def answers(spark, tmp_path, kind):
    rows = read_keyed(spark, str(tmp_path / "out"), "string", kind).collect()
    return sorted(((r["id"], r["status"], (r["ts"] - START).total_seconds() / 60, r["sequence"], r["previous"]) for r in rows), key=repr)


def test_files_out_of_order_over_a_restart(spark, tmp_path):
    """Files in random order within the delay, a run per two files; a busy id, ties, and NULL as a status."""
    rng = random.Random(11)
    rows = [("hot" if n % 3 else f"k{n % 7}", rng.choice(["a", "b", None]), n // 3, n) for n in range(360)]
    parts = [rows[i : i + 60] for i in range(0, 360, 60)]
    for n, k in enumerate((1, 0, 3, 2, 5, 4)):
        rng.shuffle(parts[k])
        drop(tmp_path / "in", str(n), parts[k])
        if n % 2:
            run(spark, tmp_path, terminal=())
    drop(tmp_path / "in", "clock", [(None, None, 10_000, None)])
    run(spark, tmp_path, terminal=())
    seen = spark.createDataFrame([(i, s, START + timedelta(minutes=m), n) for i, s, m, n in rows], SEEN)
    want = status_changes(seen, F.lit(0), "id", ("ts", "sequence")).collect()
    want = sorted(((r["id"], r["status"], (r["ts"] - START).total_seconds() / 60, r["sequence"], r["previous"]) for r in want), key=repr)
    assert answers(spark, tmp_path, "change") == want
    assert answers(spark, tmp_path, "late") == []


def test_late_rows_are_handed_on(spark, tmp_path):
    drop(tmp_path / "in", "0", [("a", "x", 0, 1), ("b", "x", 5, 2)])
    drop(tmp_path / "in", "1", [("a", "y", 600, 3)])
    run(spark, tmp_path)  # ends with the watermark past the first spans
    drop(tmp_path / "in", "2", [("a", "z", 10, 4), ("a", "w", 590, 5), ("new", "x", 1, 6)])
    drop(tmp_path / "in", "3", [(None, None, 10_000, None)])
    run(spark, tmp_path)
    assert [(i, s) for i, s, *_ in answers(spark, tmp_path, "late")] == [("a", "z")]
    # An id that was not seen before has no walked span, so nothing of it is late.
    assert [(i, s, p) for i, s, _, _, p in answers(spark, tmp_path, "change")] == [
        ("a", "w", "x"), ("a", "x", None), ("a", "y", "w"), ("b", "x", None), ("new", "x", None),
    ]


def test_nothing_follows_a_terminal_status(spark, tmp_path):
    drop(tmp_path / "in", "0", [("a", "in_progress", 0, 1), ("a", "failed", 3, 2), ("a", "in_progress", 5, 3)])
    drop(tmp_path / "in", "1", [("a", "completed", 100, 4), (None, None, 10_000, None)])
    run(spark, tmp_path)
    assert [s for _, s, *_ in answers(spark, tmp_path, "change")] == ["failed", "in_progress"]


def test_deadlines_are_timers(spark, tmp_path):
    """Overdue when the clock passes the deadline, and not any more once a terminal status comes."""
    rows = [("slow", "in_progress", 0), ("slow", "in_progress", 30), ("done", "in_progress", 0), ("done", "completed", 200),
            ("new", "in_progress", 380), ("lost", None, 0)]
    drop(tmp_path / "in", "0", [(i, s, m, n) for n, (i, s, m) in enumerate(rows) if m < 100])
    drop(tmp_path / "in", "1", [(i, s, m, n) for n, (i, s, m) in enumerate(rows) if m >= 100])
    as_of = 420
    drop(tmp_path / "in", "2", [(None, None, as_of + 180, None)])
    run(spark, tmp_path, terminal=(), timeout_minutes=90, changes=False)
    found = last_summaries(read_keyed(spark, str(tmp_path / "out"), "string", "summary"))
    seen = spark.createDataFrame([(i, s, START + timedelta(minutes=m), n) for n, (i, s, m) in enumerate(rows)], SEEN)
    want = poll_timeouts(seen, F.lit(START + timedelta(minutes=as_of)), 90, sequence="sequence")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {r["id"] for r in found.collect() if r["timed_out"]} == {"slow", "lost"}
    assert answers(spark, tmp_path, "change") == []


@pytest.mark.parametrize("before", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_the_setting_is_put_back(spark, before):
    own = spark.conf.get(PROVIDER, None)
    try:
        if before:
            spark.conf.set(PROVIDER, before)
        default = spark.conf.get(PROVIDER, None)
        with rocks_state(spark):
            assert "RocksDB" in spark.conf.get(PROVIDER)
        assert spark.conf.get(PROVIDER, None) == default
    finally:
        spark.conf.unset(PROVIDER)
    assert spark.conf.get(PROVIDER, None) == own


def test_ids_share_the_state(spark, tmp_path):
    """Calls to the store grow with buckets: as many ids as there are make one timer a span and bucket."""
    rows = [(f"k{n % 40}", "abc"[n * 7 % 11 % 3], n // 8, n) for n in range(400)]
    for k in (1, 0):
        drop(tmp_path / "in", str(k), rows[k * 200 : k * 200 + 200])
    drop(tmp_path / "in", "clock", [(None, None, 10_000, None)])
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    polled = keyed_status(stream, "3 hours", 1800, terminal=("c",), timeout_minutes=30, buckets=2)
    query = write_keyed(polled, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    timers = [s["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < sum(timers) <= 2 * (2 + 40)
    seen = spark.createDataFrame([(i, s, START + timedelta(minutes=m), n) for i, s, m, n in rows], SEEN)
    ended = seen.where("status = 'c'").groupBy("id").agg(F.min("sequence").alias("_end"))
    live = seen.join(ended, "id", "left").where("_end is null or sequence <= _end").drop("_end")
    want = [(r["id"], r["status"], r["sequence"], r["previous"]) for r in status_changes(live, F.lit(0), "id", ("ts", "sequence")).collect()]
    got = [(i, s, n, p) for i, s, _, n, p in answers(spark, tmp_path, "change")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["id"] for r in last_summaries(read_keyed(spark, str(tmp_path / "out"), "string", "summary")).collect()} == {r[0] for r in rows}


def test_whole_numbers_and_missing_values(spark, tmp_path):
    """Ids and sequences past 2^53 stay exact beside rows without an id (an id of its own here), a time or a sequence."""
    big, at = 2**60 + 1, START.isoformat()
    lines = [{"id": big, "status": "a", "ts": at, "sequence": big}, {"id": big, "status": "b", "ts": at}, {"status": "a", "ts": at, "sequence": 1},
             {"id": big, "status": "a", "sequence": 5}, {"id": 0, "status": None, "ts": at, "sequence": big + 1}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, lines)))
    time.sleep(0.02)
    (tmp_path / "in" / "1.json").write_text(json.dumps({"ts": (START + timedelta(days=9)).isoformat()}))
    stream = spark.readStream.schema(SEEN.replace("id string", "id long")).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    write_keyed(keyed_status(stream, "3 hours", 1800, terminal=(), buckets=1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [(r["id"], r["status"], r["sequence"], r["previous"]) for r in read_keyed(spark, str(tmp_path / "out"), "long", "change").collect()]
    assert sorted(got, key=repr) == sorted([(big, "a", big, None), (big, "b", None, "a"), (0, None, big + 1, None), (None, "a", 1, None)], key=repr)


def test_triggers_do_not_grow_with_files(spark, tmp_path):
    """A table in more files is dealt to as many triggers."""
    from inkwell.plans.streams import out_of_order

    rows = [(n, START + timedelta(minutes=n)) for n in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    sizes = []
    stream = out_of_order(spark, str(tmp_path), F.col("event_id"), F.col("ts"))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: sizes.append(b.count()))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 400 and len(sizes) <= 5
