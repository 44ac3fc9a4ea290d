"""Cases that were wrong once."""

import mimetypes

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text, times
from inkwell.operators import dedup, documents, results, tracking
from inkwell.operators.groups import block_of
from inkwell.streaming.rates import current_usage, rate_usage_stream, write_updates


@pytest.mark.parametrize("cut", [False, True])
def test_null_is_a_status(spark, cut, request):
    if cut:
        request.getfixturevalue("small_limits")
    seen = spark.createDataFrame([("k", i, s) for i, s in enumerate(["x", None, None, "x", "x", "y"])], "id string, ts int, status string")
    got = tracking.status_changes(seen, block_of("ts")).orderBy("ts").collect()
    assert [(r["ts"], r["status"], r["previous"]) for r in got] == [(0, "x", None), (1, None, "x"), (3, "x", None), (5, "y", "x")]
    only = tracking.status_changes(seen.where("ts = 1"), block_of("ts")).collect()
    assert [(r["status"], r["previous"]) for r in only] == [(None, None)]


def test_iso_forms(column):
    values = [
        "2024-01-01T10:00", "2024-01-01 10:00", "2024-01-01T10", "20240101T101112", "20240101", "2024-01-01", "1704067200",
        "2024-01-01T10:00+02:00", "2024-01-01T10:00:05.25Z", "2024-01-01T10:00:05,25", "2024", "12345678", "2024-13-01", "x", None,
    ]
    want = [f"2024-01-01 {c}" for c in (
        "10:00:00", "10:00:00", "10:00:00", "10:11:12", "00:00:00", "00:00:00", "00:00:00", "08:00:00", "10:00:05", "10:00:05"
    )] + ["N/A"] * 5
    assert column(times.format_time, values) == want


def test_old_batches_without_seconds_are_old(column):
    as_of = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    assert column(lambda c: times.older_than(c, as_of), ["2024-01-01T10:00", "2024-05-30T10"]) == [True, False]


def test_lines_of_blanks_are_skipped(spark):
    lines = spark.createDataFrame([("\t",), ("  ",), ("",), ('{"custom_id": "1"}',)], "value string")
    assert [r["custom_id"] for r in results.parse_lines(lines).collect()] == ["1"]


def test_prompts_without_text_are_left_out_and_counted(spark):
    prompts = spark.createDataFrame([(0, None), (1, "a"), (2, "a"), (3, None)], "idx int, text string")
    assert [(r["idx"], r["text"]) for r in dedup.unique_prompts(prompts).collect()] == [(1, "a")]
    assert dedup.missing_prompts(prompts).first()[0] == 2


def test_unique_prompts_neither_sort_nor_aggregate_texts(spark):
    prompts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("idx"), "text")
    plan = dedup.unique_prompts(prompts)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_mime_table_is_pythons():
    known = mimetypes.MimeTypes(filenames=()).types_map[1]
    assert set(text.TEXT_MIME_EXTENSIONS) >= {e[1:] for e, t in known.items() if t.startswith("text/")} - {"wasm"}


def test_skipped_members_have_a_reason(spark):
    rows = [("a.md", 5), ("b.rst", 6), ("c.markdown", 7), ("d.txt", 101), ("e.txt", None), ("f.exe", 1), (None, 1)]
    manifest = spark.createDataFrame(rows, "rel_path string, size long")
    got = {r["rel_path"]: r["skipped"] for r in documents.member_verdicts(manifest, limit=100).collect()}
    assert got == {"a.md": None, "b.rst": None, "c.markdown": None, "d.txt": "too large", "e.txt": "size unknown",
                   "f.exe": "not text by name", None: "no name"}
    assert documents.archive_members(manifest, limit=100).count() == 3


def test_ties_in_time_are_decided(spark):
    seen = spark.createDataFrame([("k", 1, 1, "b"), ("k", 1, 2, "a")], "id string, ts int, seq int, status string")
    seen = seen.withColumn("ts", F.timestamp_seconds("ts"))
    for sequence, want in ((None, "b"), ("seq", "a")):
        got = tracking.poll_timeouts(seen, F.current_timestamp(), sequence=sequence).first()
        assert got["final_status"] == want


BATCH = "id string, status string, created_at string, model string, request_count long, last_updated string, metadata map<string,string>, n long"


def batch(spark, *rows):
    return spark.createDataFrame([(i, s, c, None, 0, None, None, n) for i, s, c, n in rows], BATCH)


def test_later_rows_stay_whatever_the_order_of_upserts(spark, tmp_path):
    path, order = f"{tmp_path}/table", ["created_at", "n"]
    tracking.store_upsert(batch(spark, ("a", "new", "2024-01-02", 9), ("b", "first", "2024-01-01", -5)), path, order)
    tracking.store_upsert(batch(spark, ("a", "old", "2024-01-01", 10), ("b", "second", "2024-01-01", 10)), path, order)
    tracking.store_upsert(batch(spark, ("b", "third", "2024-01-01", 9), ("c", "only", "2024-01-01", 1)), path, order)
    got = {r["id"]: r["status"] for r in tracking.read_batches(spark, path).collect()}
    assert got == {"a": "new", "b": "second", "c": "only"}
    assert "version" not in tracking.read_batches(spark, path).columns
    # The same update again, and an equal version, replace.
    tracking.store_upsert(batch(spark, ("a", "fixed", "2024-01-02", 9)), path, order)
    assert tracking.read_batches(spark, path, "a").first()["status"] == "fixed"


def test_no_row_of_a_backlog_is_late(spark, tmp_path):
    source = f"{tmp_path}/source"
    for n, day in enumerate(("2024-06-01", "2020-01-01", "2024-06-01")):
        df = spark.createDataFrame([(f"{day} 00:00:10", 5)], "t string, tokens long")
        df.select(F.col("t").cast("timestamp").alias("ts"), "tokens").coalesce(1).write.parquet(f"{source}/f{n}")
    stream = spark.readStream.schema("ts timestamp, tokens long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    usage = rate_usage_stream(stream, delay=None)
    write_updates(usage, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted((str(r["minute"])[:10], r["tokens"]) for r in current_usage(spark, f"{tmp_path}/out").collect())
    assert got == [("2020-01-01", 5), ("2024-06-01", 10)]
