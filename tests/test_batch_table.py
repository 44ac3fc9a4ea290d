"""The table on disk: what a commit writes, what a crash leaves, compaction and two writers."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import batch_table as table
from inkwell.schemas import BATCH


def rows(spark, *values):
    """``(id, status, created_at)``."""
    return spark.createDataFrame([(i, s, c, None, 0, None, {}) for i, s, c in values], BATCH)


def stored(spark, path):
    return {r["id"]: r["status"] for r in table.read_batches(spark, path).collect()}


def segments(path, kind="rows"):
    return sorted(p.name for p in (path / kind).glob("segment=*")) if (path / kind).exists() else []


def test_a_commit_writes_its_own_rows_only(spark, tmp_path):
    path = tmp_path / "t"
    table.store_upsert(rows(spark, *[(f"b{i}", "x", "1") for i in range(300)]), str(path), ["created_at"])
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    table.store_upsert(rows(spark, ("b1", "y", "2"), ("b1", "z", "3"), ("new", "y", "1")), str(path), ["created_at"])
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert before.items() <= after.items()
    added = spark.read.parquet(*[str(p) for p in after if p not in before])
    assert {r["id"]: r["status"] for r in added.collect()} == {"b1": "z", "new": "y"}
    assert len(stored(spark, str(path))) == 301


def test_against_a_plain_table_with_deletions_and_compaction(spark, tmp_path):
    """Any order of updates, deletions and compactions gives what replaying them gives."""
    rng, path, plain = random.Random(7), str(tmp_path / "t"), {}
    for step in range(14):
        values = [(f"b{rng.randrange(8)}", f"s{step}.{n}", f"{rng.randrange(5)}") for n in range(6)]
        kind = rng.choice(["upsert", "upsert", "upsert", "delete", "compact"])
        if kind == "upsert":
            last = {}
            for i, s, c in values:
                if i not in last or c > last[i][1]:
                    last[i] = (s, c)
            # Of equal versions in one call any may stay, so make them differ.
            table.store_upsert(rows(spark, *[(i, s, c) for i, (s, c) in last.items()]), path, ["created_at"])
            for i, (s, c) in last.items():
                if i not in plain or c >= plain[i][1]:
                    plain[i] = (s, c)
        elif kind == "delete":
            ids = {values[0][0], values[1][0], "nobody"}
            table.store_delete(spark.createDataFrame([(i,) for i in ids], "id string"), path)
            plain = {i: v for i, v in plain.items() if i not in ids}
        else:
            table.compact_batches(spark, path, rng.choice([1, 3, 100]))
        assert stored(spark, path) == {i: s for i, (s, _) in plain.items()}
        for i in ("b1", "b5"):
            one = [r["status"] for r in table.read_batches(spark, path, i).collect()]
            assert one == ([plain[i][0]] if i in plain else [])


def test_a_crash_between_any_two_writes_loses_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    table.store_upsert(rows(spark, ("a", "one", "1"), ("b", "one", "1")), str(path), ["created_at"])

    def stop(*args):
        raise RuntimeError("lost")

    steps = [
        lambda: table.store_upsert(rows(spark, ("a", "two", "2"), ("c", "two", "2")), str(path), ["created_at"], "w", 0),
        lambda: table.store_delete(spark.createDataFrame([("b",)], "id string"), str(path), "w", 1),
        lambda: table.compact_batches(spark, str(path)),
    ]
    wants = [{"a": "two", "b": "one", "c": "two"}, {"a": "two", "c": "two"}, {"a": "two", "c": "two"}]
    for step, want in zip(steps, wants):
        before = stored(spark, str(path))
        for name in ("commit", "_publish", "_write_segment"):
            with monkeypatch.context() as m:
                m.setattr(table, name, stop)
                with pytest.raises(RuntimeError):
                    step()
            assert stored(spark, str(path)) == before
        step()
        assert stored(spark, str(path)) == want
        step()  # once more, as after a crash that came right after it
        assert stored(spark, str(path)) == want
    # What crashes and compaction left goes; what a kept manifest names stays.
    assert table.vacuum_batches(spark, str(path)) == 0
    assert table.vacuum_batches(spark, str(path), keep=1, hours=0) > 0
    assert len(segments(path, "base")) == 1 and not segments(path) and not segments(path, "gone")
    assert stored(spark, str(path)) == wants[-1] and len(list((path / "manifest").glob("*.json"))) == 1


def test_a_half_written_manifest_is_not_read(spark, tmp_path):
    path = tmp_path / "t"
    table.store_upsert(rows(spark, ("a", "one", "1")), str(path), ["created_at"])
    (path / "manifest" / ".draft-x").write_text('{"number": 2, ')
    assert stored(spark, str(path)) == {"a": "one"}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The second to publish a number goes on from the first's manifest."""
    path, own, other = str(tmp_path / "t"), table._publish, []

    def publish(*args):
        if not other:
            other.append(1)
            table.store_upsert(rows(spark, ("b", "theirs", "1")), path, ["created_at"])
        return own(*args)

    monkeypatch.setattr(table, "_publish", publish)
    table.store_upsert(rows(spark, ("a", "mine", "1")), path, ["created_at"])
    assert stored(spark, path) == {"a": "mine", "b": "theirs"} and table.manifest(spark, path).number == 2

    other.clear()

    def publish_while_compacting(*args):
        if not other:
            other.append(1)
            table.store_upsert(rows(spark, ("a", "later", "1"), ("c", "new", "1")), path, ["created_at"])
        return own(*args)

    monkeypatch.setattr(table, "_publish", publish_while_compacting)
    assert table.compact_batches(spark, path)
    assert stored(spark, path) == {"a": "later", "b": "theirs", "c": "new"}

    other.clear()

    def compact_twice(*args):
        if not other:
            other.append(1)
            assert table.compact_batches(spark, path)
        return own(*args)

    monkeypatch.setattr(table, "_publish", compact_twice)
    assert not table.compact_batches(spark, path) and stored(spark, path) == {"a": "later", "b": "theirs", "c": "new"}


def test_buckets_grow_with_compaction_and_one_id_reads_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    table.store_upsert(rows(spark, *[(f"b{i}", "x", "1") for i in range(400)]), path, ["created_at"])
    assert table.compact_batches(spark, path, rows_per_bucket=4) and table.manifest(spark, path).buckets == 100
    compacted = table.read_batches(spark, path)
    assert "Exchange" not in compacted._jdf.queryExecution().executedPlan().toString() and compacted.count() == 400
    table.store_upsert(rows(spark, ("b3", "y", "2")), path, ["created_at"])
    one = table._merged(spark, path, table.manifest(spark, path), "b3")
    assert [r["status"] for r in one.collect()] == ["y"]
    # Read back unmerged: files of one bucket per segment, whatever their bucket counts.
    for kind in ("base", "rows"):
        part = table._read(spark, path, table.manifest(spark, path).segments, kind, "b3")
        assert part.select(F.input_file_name()).distinct().count() == 1
    assert not table.compact_batches(spark, str(tmp_path / "none"))


def test_rows_without_an_id_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    table.store_upsert(spark.createDataFrame([("a", "x", 3), (None, "y", 4)], "id string, status string, n int"), path, ["n"])
    row = table.read_batches(spark, path).collect()
    assert [(r["id"], r["status"], r["model"]) for r in row] == [("a", "x", None)]
    table.store_delete(spark.createDataFrame([("a",), (None,)], "id string"), path)
    table.store_upsert(spark.createDataFrame([("a", "back", 1)], "id string, status string, n int"), path, ["n"])
    assert stored(spark, path) == {"a": "back"}  # older than what was deleted, but given later
