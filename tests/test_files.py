"""Files in and out."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import tracking
from inkwell.operators.documents import file_summary
from inkwell.schemas import STORE_LINE
from inkwell.sources import files, sinks
from inkwell.sources.readers import Readers, process_files
from tests.plan_nodes import exchanges


def test_prompt_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 1 \n\n\t2\n")
    (tmp_path / "b.txt").write_text("3\u00a0")
    (tmp_path / "c.md").write_text("no")
    got = files.prompt_lines(spark, str(tmp_path)).orderBy("prompt_idx").collect()
    assert [(r["prompt_idx"], r["text"]) for r in got] == [(0, "1"), (1, "2"), (2, "3")]
    one = files.prompt_lines(spark, str(tmp_path / "a.txt")).orderBy("prompt_idx").collect()
    assert [r["text"] for r in one] == ["1", "2"]
    every = files.prompt_lines(spark, str(tmp_path), object_prefix=True)
    assert {r["text"] for r in every.collect()} == {"1", "2", "3", "no"}
    with pytest.raises(FileNotFoundError):
        files.prompt_lines(spark, str(tmp_path / "missing"))


def test_prompt_lines_keep_order_over_many_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("\n".join(f"line {i} " + "x" * 90 for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = files.prompt_lines(spark, str(tmp_path)).orderBy("prompt_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r["text"].split()[1]) for r in got] == list(range(5000))


def test_read_jsonl(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"custom_id": "1"}\n\n{"custom_id": "2", "usage": {"total_tokens": 5}}\n')
    got = files.read_jsonl(spark, str(path)).orderBy("custom_id").collect()
    assert [r["custom_id"] for r in got] == ["1", "2"] and got[1]["usage"]["total_tokens"] == 5
    path.write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(path)).collect()
    assert files.read_store(spark, str(tmp_path / "none")).count() == 0


def test_batch_records(spark, tmp_path):
    (tmp_path / "b1.json").write_text(
        json.dumps({"id": "other", "status": "completed", "created_at": "2024-01-01T00:00:00", "model": "gpt",
                    "results": [{"custom_id": "0"}, {"custom_id": "1"}], "metadata": {"file_size": 12, "auto": True}}, indent=2)
    )
    (tmp_path / "b2 +ü.json").write_text("{}")
    (tmp_path / "b3.json").write_text("{not json")
    records = files.read_batch_records(spark, str(tmp_path))
    got = {r["id"]: r for r in records.collect()}
    assert set(got) == {"b1", "b2 +ü"}
    assert (got["b2 +ü"]["status"], got["b2 +ü"]["request_count"], got["b2 +ü"]["metadata"], got["b2 +ü"]["results"]) == ("unknown", 0, {}, [])
    assert got["b1"]["last_updated"] == "2024-01-01T00:00:00" and got["b1"]["metadata"] == {"file_size": "12", "auto": "true"}
    assert [tuple(r)[:2] for r in files.child_rows(records, "results").collect()] == [("b1", "0"), ("b1", "1")]
    assert files.child_rows(records, "errors").count() == 0


def test_detected_inputs(spark, tmp_path):
    for name in ("batch_1704067200_x.jsonl", "batch_abc.jsonl", "batch_known.jsonl", "other.jsonl"):
        (tmp_path / name).write_text("12345")
    listed = files.list_inputs(spark, str(tmp_path))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    tracked = spark.createDataFrame([("batch_known",)], "id string")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    got = {r["id"]: r for r in tracking.detected_batches(listed, tracked, now).collect()}
    assert set(got) == {"batch_1704067200_x", "batch_abc"}
    row = got["batch_1704067200_x"]
    assert (row["status"], row["created_at"]) == ("detected", "2024-01-01T00:00:00")
    assert row["metadata"]["file_size"] == "5" and row["metadata"]["auto_detected"] == "true"
    assert got["batch_abc"]["created_at"] < "2030"
    usage = tracking.storage_usage(files.list_files(spark, str(tmp_path), "*.jsonl")).first()
    assert (usage["files"], usage["bytes"], usage["megabytes"]) == (4, 20, 20 / 1048576)


@pytest.fixture
def mixed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("hello world\nagain")
    (folder / "b.py").write_text("class A:\n    def f(self): pass\n")
    (folder / "c.HTML").write_text("<p>é</p>")
    (folder / "d.txt").write_bytes(b"\xff\xfe bad")
    (folder / "e.pdf").write_bytes(b"%PDF page one|page two")
    (folder / "f.zip").write_bytes(b"PK")
    return folder


def pdf_reader(df):
    pages = F.size(F.split(F.col("content").cast("string"), r"\|"))
    return df.select(
        "filename", F.col("content").cast("string").alias("text"), "file_type",
        files.metadata_struct(filename=F.col("filename"), file_size=F.col("length"), pages=pages).alias("metadata"),
    )


def zip_reader(df):
    member = F.explode(F.expr("array(named_struct('p', 'x/in.md', 'c', 'inner'), named_struct('p', 'y.exe', 'c', 'no'), named_struct('p', 'z.js', 'c', 'let a'))"))
    return df.select(F.col("filename").alias("archive"), member.alias("m")).select(
        "archive", F.col("m.p").alias("rel_path"), F.length("m.c").cast("bigint").alias("size"),
        F.col("m.c").cast("binary").alias("content"),
    )


def test_separate_files(spark, mixed):
    got = {r["filename"]: r for r in process_files(spark, str(mixed)).collect()}
    assert len(got) == 6 and len({r["id"] for r in got.values()}) == 6
    a = got["a.txt"]["metadata"]
    assert (got["a.txt"]["text"], a["lines"], a["characters"], a["words"], a["file_size"]) == ("hello world\nagain", 2, 17, 3, 17)
    b = got["b.py"]["metadata"]
    assert (b["classes"], b["functions"], b["lines"], b["words"]) == (1, 1, 3, None)
    assert (got["c.HTML"]["file_type"], got["c.HTML"]["metadata"]["extension"]) == ("code", "html")
    assert got["d.txt"]["text"].startswith("Error extracting text from TXT") and got["d.txt"]["metadata"]["error"]
    assert got["e.pdf"]["file_type"] == "error" and "no reader registered for pdf" in got["e.pdf"]["text"]
    assert got["f.zip"]["file_type"] == "txt"
    assert not any(r["from_zip"] for r in got.values())
    assert "Processed 6 files" in file_summary(process_files(spark, str(mixed))).orderBy("number").first()["entry"]


def opened(df):
    """The rows of a query, and the number of files each of its scans opened."""
    counts = []

    def walk(node):
        if node.metrics().contains("numFiles"):
            counts.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    rows = df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return rows, counts


def test_files_of_other_types_are_not_opened(spark, mixed):
    (mixed / "g h.PDF").write_bytes(b"two")
    typed = files.typed_files(files.read_bytes(spark, str(mixed)), archives=True)
    pdfs = typed.where(F.col("file_type") == "pdf").select("filename", "content")
    rows, counts = opened(pdfs)
    assert {r["filename"] for r in rows} == {"e.pdf", "g h.PDF"} and counts == [2]


def test_archives_and_readers(spark, mixed):
    readers = Readers()
    readers.register("pdf", pdf_reader)
    readers.register("zip", zip_reader)
    got = {r["filename"]: r for r in process_files(spark, str(mixed), "zip", readers).collect()}
    assert set(got) == {"a.txt", "b.py", "c.HTML", "d.txt", "e.pdf", "x/in.md", "z.js"}
    assert got["e.pdf"]["metadata"]["pages"] == 2 and got["e.pdf"]["file_type"] == "pdf"
    assert (got["x/in.md"]["file_type"], got["x/in.md"]["from_zip"], got["x/in.md"]["text"]) == ("txt", True, "inner")
    assert (got["z.js"]["file_type"], got["z.js"]["metadata"]["extension"]) == ("code", "js")
    bare = {r["filename"]: r for r in process_files(spark, str(mixed), "zip").collect()}
    assert bare["f.zip"]["file_type"] == "error"


def test_combined_files(spark, mixed):
    row = process_files(spark, str(mixed), "combine", glob="[ab].*").first()
    assert row["text"] == (
        "\n\n==== FILE: a.txt ====\n\nhello world\nagain\n\n==== FILE: b.py ====\n\nclass A:\n    def f(self): pass\n"
    )
    with pytest.raises(ValueError):
        process_files(spark, str(mixed), "other")


def test_digests_prompts_and_logs(spark, mixed, tmp_path):
    got = {r["filename"]: r["digest"] for r in files.content_digest(files.read_bytes(spark, str(mixed))).collect()}
    assert got["d.txt"] == hashlib.md5(b"\xff\xfe bad").hexdigest()
    (tmp_path / "s.md").write_text("system\nlines")
    (tmp_path / "u.md").write_text("user")
    assert tuple(files.default_prompts(spark, str(tmp_path / "s.md"), str(tmp_path / "u.md")).first()) == ("system\nlines", "user")
    (tmp_path / "info.log").write_text("\n".join(f"l{i}" for i in range(250)))
    tail = [r[0] for r in files.recent_lines(spark, str(tmp_path / "info.log")).collect()]
    assert tail == [f"l{i}" for i in range(150, 250)]
    assert files.recent_lines(spark, str(tmp_path / "no.log")).first()[0] == "No log file found"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("0", None, 'say "hi", x\ny', 1.5), ("1", "r", "", 2.0)], "custom_id string, role string, content string, v double")
    path = str(tmp_path / "j")
    sinks.write_jsonl(df, path)
    raw = sorted(r[0] for r in spark.read.text(path).collect())
    assert json.loads(raw[0]) == {"custom_id": "0", "content": 'say "hi", x\ny', "v": 1.5}
    sinks.export_json(df, str(tmp_path / "n"))
    assert '"role":null' in sorted(r[0] for r in spark.read.text(str(tmp_path / "n")).collect())[0]
    sinks.export_csv(df, str(tmp_path / "c"))
    text = "".join(sorted((p.read_text() for p in (tmp_path / "c").glob("*.csv")), reverse=False))
    assert 'custom_id,role,content,v\n0,,"say ""hi"", x\ny",1.5\n' in text and "1,r,,2.0\n" in text
    sinks.write_jsonl(df, str(tmp_path / "p"), partition_by="custom_id")
    assert (tmp_path / "p" / "custom_id=1").is_dir()


def test_results_are_replaced_per_batch(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = lambda b, ids: spark.createDataFrame([(b, i) for i in ids], "batch_id string, custom_id string")
    sinks.write_results(rows("b1", "ab").unionByName(rows("b2", "c")), path)
    sinks.write_results(rows("b1", "z"), path)
    got = {(r["batch_id"], r["custom_id"]) for r in files.read_results(spark, path).collect()}
    assert got == {("b1", "z"), ("b2", "c")}
    assert files.read_results(spark, path, "b2").count() == 1
    assert files.read_results(spark, str(tmp_path / "none"), "b2").count() == 0


def test_store_appends(spark, tmp_path):
    path = str(tmp_path / "store")
    row = spark.createDataFrame([("p", ("1", None, None, "m", None, None, "c"))], STORE_LINE)
    sinks.append_store(row, path)
    sinks.append_store(row, path)
    got = files.read_store(spark, path).collect()
    assert len(got) == 2 and got[0]["response"]["content"] == "c"


def test_numbering_lines_moves_no_text(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"f{n}.txt").write_text("\n".join(f"{n} {i} " + "x" * 90 for i in range(400)) + "\n\n \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = files.prompt_lines(spark, str(tmp_path))
        assert not exchanges(got, "text") and not exchanges(got, "value")
        rows = got.orderBy("prompt_idx").collect()
        # More splits than may be broadcast give the same.
        lines = got.drop("prompt_idx")
        assert [r["prompt_idx"] for r in rows] == list(range(2000))
        assert [tuple(map(int, r["text"].split()[:2])) for r in rows] == [(n, i) for n in range(5) for i in range(400)]
        assert lines.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_too_many_splits_are_sorted(spark, tmp_path, monkeypatch):
    for n in range(3):
        (tmp_path / f"f{n}.txt").write_text("\n".join(f"{n} {i}" for i in range(50)))
    got = [tuple(r) for r in files.prompt_lines(spark, str(tmp_path)).orderBy("prompt_idx").collect()]
    monkeypatch.setattr(files.number_lines, "__defaults__", (2,))
    assert [tuple(r) for r in files.prompt_lines(spark, str(tmp_path)).orderBy("prompt_idx").collect()] == got


def test_changed_splits_raise(spark, tmp_path):
    (tmp_path / "f.txt").write_text("\n".join(f"{i} " + "x" * 90 for i in range(400)))
    got = files.prompt_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        with pytest.raises(Exception, match="splits of the files have changed"):
            got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_prompt_files_grow_in_number(spark, tmp_path, monkeypatch):
    """A task writes a bounded part of the texts, whatever their sum."""
    from inkwell.plans import files as plan

    monkeypatch.setattr(plan, "FILE_CHARS", 200, raising=False)
    folders = []
    fresh = plan.fresh_folder
    monkeypatch.setattr(plan, "fresh_folder", lambda s, n: folders.append(fresh(s, n)) or folders[-1])
    rows = [(i, f"one {i}\n\n two {i} " + "x" * 90) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["text"] for r in plan.prompt_files(spark, str(tmp_path)).orderBy("prompt_idx").collect()]
    assert got == [line.strip() for _, t in rows for line in t.split("\n") if line]
    assert len(spark.read.text(folders[0]).inputFiles()) > 20
