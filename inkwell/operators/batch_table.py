"""The batch table on disk: segments that are only ever added, and a manifest that says which count.

An update writes its own rows as a new segment and then publishes a manifest
that names it; nothing is rewritten. Readers merge: of an id the row with the
last version counts, of equal versions the one of the later segment, and a
deletion ends all rows of segments before it. ``compact_batches`` folds the
segments into one, with as many id buckets as the table has grown to, and
``vacuum_batches`` deletes what no manifest names any more.

A step that dies before its manifest is published leaves files nobody reads; a
manifest is whole or absent. Two writers at once are kept apart by the number of
the manifest, which only one can publish; the other goes on from the new one.
This needs a file system whose rename refuses an existing name; elsewhere let one
writer work at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators.groups import latest_by
from inkwell.schemas import BATCH
from inkwell.session import delete_path, file_system, path_exists

#: Buckets of a new table; compaction chooses anew.
BUCKETS = 32
ROWS_PER_BUCKET = 1_000_000

VERSION = T.ArrayType(T.StringType())
STORED = T.StructType([*BATCH.fields, T.StructField("version", VERSION)])
PLACE = [T.StructField("segment", T.StringType()), T.StructField("bucket", T.IntegerType())]
#: Where segments lie: rows of updates, deleted ids, and compacted rows.
KINDS = {"rows": STORED, "gone": T.StructType([BATCH["id"]]), "base": STORED}


@dataclass(frozen=True)
class Segment:
    kind: str
    name: str
    seq: int
    buckets: int

    def path(self, table: str) -> str:
        return f"{table}/{self.kind}/segment={self.name}"


@dataclass(frozen=True)
class Manifest:
    """Version ``number`` of the table; ``applied`` has the last epoch of each stream that writes it."""

    number: int = 0
    buckets: int = BUCKETS
    segments: tuple[Segment, ...] = ()
    applied: dict[str, int] = field(default_factory=dict)

    def of(self, *kinds: str) -> list[Segment]:
        return [s for s in self.segments if s.kind in kinds]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path}/manifest"
    if not path_exists(spark, folder):
        return []
    fs, where = file_system(spark, folder)
    names = [status.getPath().getName() for status in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _manifest_path(path: str, number: int) -> str:
    return f"{path}/manifest/{number:020d}.json"


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest:
    """The newest manifest, or that of ``number``; an empty one if there is no table."""
    if number is None:
        number = max(_numbers(spark, path), default=0)
    if not number:
        return Manifest()
    fs, where = file_system(spark, _manifest_path(path, number))
    stream = fs.open(where)
    try:
        stored = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(stored["number"], stored["buckets"], tuple(Segment(**s) for s in stored["segments"]), stored["applied"])


def _publish(spark: SparkSession, path: str, new: Manifest) -> bool:
    """Write the manifest under its number; False if another has that number."""
    final, draft = _manifest_path(path, new.number), f"{path}/manifest/.draft-{uuid.uuid4().hex}"
    fs, where = file_system(spark, draft)
    stream = fs.create(where, False)
    try:
        stream.write(json.dumps(asdict(new)).encode())
    finally:
        stream.close()
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    refuse = context._gateway.new_array(kinds, 1)
    refuse[0] = kinds.NONE
    target = jvm.org.apache.hadoop.fs.Path(final)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(where), fs.makeQualified(target), refuse)
    except Py4JJavaError:
        taken = fs.exists(target)
        fs.delete(where, False)
        if not taken:
            raise
        return False
    return True


def commit(spark: SparkSession, path: str, change: Callable[[Manifest], Manifest | None]) -> bool:
    """Publish ``change`` of the newest manifest, anew if another writer was first; None changes nothing."""
    while True:
        current = manifest(spark, path)
        new = change(current)
        if new is None:
            return False
        if _publish(spark, path, replace(new, number=current.number + 1)):
            return True


def bucket_of(batch_id: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(batch_id), F.lit(buckets)).cast("int")


def _write_segment(rows: DataFrame, path: str, kind: str, buckets: int) -> str | None:
    """Write rows by bucket; the segment's name, or None if there were no rows."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    where = Segment(kind, name, 0, buckets).path(path)
    rows.withColumn("bucket", bucket_of("id", buckets)).repartition("bucket").write.partitionBy("bucket").parquet(where)
    fs, folder = file_system(spark, where)
    if any(status.getPath().getName().startswith("bucket=") for status in fs.listStatus(folder)):
        return name
    delete_path(spark, where)
    return None


def _read(spark: SparkSession, path: str, segments: Sequence[Segment], kind: str, batch_id: str | None) -> DataFrame:
    """Rows of segments of one kind with ``_seq``; of one id only its buckets are read."""
    schema = T.StructType([*KINDS[kind].fields, *PLACE])
    own = [s for s in segments if s.kind == kind]
    if not own:
        return spark.createDataFrame([], KINDS[kind]).withColumn("_seq", F.lit(0).cast("bigint"))
    rows = spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*[s.path(path) for s in own])
    if batch_id is not None:
        counts = {s.buckets for s in own}
        hit = F.lit(False)
        for n in counts:
            there = F.col("bucket") == bucket_of(F.lit(batch_id), n)
            if len(counts) > 1:
                there = F.col("segment").isin(*[s.name for s in own if s.buckets == n]) & there
            hit = there if len(counts) == 1 else hit | there
        rows = rows.where(hit).where(F.col("id") == batch_id)
    seq = F.create_map(*[x for s in own for x in (F.lit(s.name), F.lit(s.seq).cast("bigint"))])
    return rows.withColumn("_seq", F.element_at(seq, F.col("segment"))).drop("segment", "bucket")


def _merged(spark: SparkSession, path: str, current: Manifest, batch_id: str | None = None) -> DataFrame:
    """Live rows with their version. A compacted table is read as it lies, without a shuffle."""
    rows, gone = current.of("rows"), current.of("gone")
    base = _read(spark, path, current.of("base"), "base", batch_id)
    if not rows and not gone:
        return base.select(*STORED.names)
    every = base.unionByName(_read(spark, path, rows, "rows", batch_id)) if rows else base
    if gone:
        ends = _read(spark, path, gone, "gone", batch_id).groupBy("id").agg(F.max("_seq").alias("_gone"))
        every = every.join(ends, "id", "left").where(F.col("_gone").isNull() | (F.col("_seq") > F.col("_gone"))).drop("_gone")
    rank = F.struct(F.coalesce("version", F.array().cast(VERSION)), "_seq")
    rest = [c for c in STORED.names if c != "id"]
    kept = every.groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return kept.select("id", "_row.*").select(*STORED.names)


def read_batches(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """The stored batch table, empty if there is none yet. One id reads one bucket of each segment."""
    return _merged(spark, path, manifest(spark, path), batch_id).drop("version")


def version_of(updates: DataFrame, order: Sequence[str]) -> Column:
    """The values of ``order`` as texts that sort as the values do, so they can be stored beside any row."""
    texts = []
    for name in order:
        kind, value = updates.schema[name].dataType, F.col(name)
        if isinstance(kind, T.IntegralType):
            value = F.lpad((value.cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif not isinstance(kind, T.StringType):
            raise TypeError(f"{name} is {kind.simpleString()}: order by whole numbers, times or texts")
        texts.append(F.coalesce(value, F.lit("")))
    return F.array(*texts)


def _append(rows: DataFrame, path: str, kind: str, writer: str | None, epoch: int) -> None:
    spark = rows.sparkSession
    before = manifest(spark, path)
    if writer is not None and before.applied.get(writer, -1) >= epoch:
        return
    name = _write_segment(rows, path, kind, before.buckets)

    def change(current: Manifest) -> Manifest | None:
        if writer is not None and current.applied.get(writer, -1) >= epoch:
            return None
        applied = current.applied if writer is None else {**current.applied, writer: epoch}
        if name is None and writer is None:
            return None
        added = () if name is None else (Segment(kind, name, current.number + 1, before.buckets),)
        return replace(current, segments=(*current.segments, *added), applied=applied)

    commit(spark, path, change)


def store_upsert(updates: DataFrame, path: str, order: Sequence[str], writer: str | None = None, epoch: int = 0) -> None:
    """Upsert into the stored table: the updates' own rows are written, no others.

    A stored row is replaced by an update that is not before it in ``order``, so
    updates may come in any order over any number of calls. Rows without an id
    are left out. A stream gives its name as ``writer`` and its ``epoch``; an
    epoch that is in the table already is not added again.
    """
    versioned = updates.where(F.col("id").isNotNull()).withColumn("version", version_of(updates, order))
    columns = [F.col(c) if c in versioned.columns else F.lit(None).cast(STORED[c].dataType).alias(c) for c in STORED.names]
    kept = [c for c in order if c not in STORED.names]
    _append(latest_by(versioned.select(*columns, *kept), "id", order).select(*STORED.names), path, "rows", writer, epoch)


def store_delete(ids: DataFrame, path: str, writer: str | None = None, epoch: int = 0) -> None:
    """Delete ids from the stored table: the ids are written. Later updates bring an id back, whatever their order."""
    _append(ids.where(F.col("id").isNotNull()).select("id").distinct(), path, "gone", writer, epoch)


def compact_batches(spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> bool:
    """Fold all segments into one with buckets of about ``rows_per_bucket``; False if there was nothing to fold.

    Updates published meanwhile stay beside the new segment. Of two compactions at once one gives up.
    """
    start = manifest(spark, path)
    if not start.of("rows", "gone"):
        return False
    live = _merged(spark, path, start)
    buckets = max(1, -(-live.count() // rows_per_bucket))
    name = _write_segment(live, path, "base", buckets)
    # It stands where its sources stood: before all that was published since.
    base = () if name is None else (Segment("base", name, start.number, buckets),)

    def change(current: Manifest) -> Manifest | None:
        if not set(start.segments) <= set(current.segments):
            return None
        return replace(current, segments=(*base, *[s for s in current.segments if s not in start.segments]), buckets=buckets)

    return commit(spark, path, change)


def vacuum_batches(spark: SparkSession, path: str, keep: int = 10, hours: float = 24.0) -> int:
    """Delete segments that none of the last ``keep`` manifests names and that are older than ``hours``; how many.

    Readers of an older manifest and writers that have not published yet need
    their segments, so ``hours`` must be longer than any of them takes.
    """
    numbers = _numbers(spark, path)
    named = {s.path("") for n in numbers[-keep:] for s in manifest(spark, path, n).segments}
    oldest, count = (time.time() - hours * 3600) * 1000, 0
    for kind in KINDS:
        if not path_exists(spark, f"{path}/{kind}"):
            continue
        fs, folder = file_system(spark, f"{path}/{kind}")
        for status in fs.listStatus(folder):
            if f"/{kind}/{status.getPath().getName()}" not in named and status.getModificationTime() <= oldest:
                fs.delete(status.getPath(), True)
                count += 1
    for number in numbers[:-keep]:
        delete_path(spark, _manifest_path(path, number))
    return count
