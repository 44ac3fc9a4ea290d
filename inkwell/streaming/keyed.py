"""Status per id in the order of event time, as keyed state with timers.

Ids are dealt to buckets by hash, and a bucket is what has state. Its rows are
kept in pieces per span of event time, as they came. When the watermark passes
the end of a span, a timer puts its pieces in order and walks all ids of the
bucket at once; what stays of an id is one row of the bucket's table. So a
micro-batch touches the spans it brings and no others, whatever an id has seen
before, calls to the state store grow with buckets and spans and not with ids,
and rows that files deliver out of time order are put right as long as they come
within the delay. Rows that come later still are handed on as ``late``, not
dropped.

A second timer per bucket is the earliest deadline of its ids: polling that has
not ended by then has run out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkwell.operators.tracking import TERMINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = (
    "kind string, status string, ts timestamp, sequence long, previous string, "
    "first_seen timestamp, last_seen timestamp, timed_out boolean"
)
COLUMNS = ["id", *[part.split()[0] for part in RESULT.split(", ")]]

#: Ids of a bucket are read and written together.
BUCKETS = 256
#: Stands for a NULL sequence on the way to Python, where whole numbers have no NULL; it is ordered last.
NO_SEQUENCE = 2**63 - 1

#: The bucket of whole-number ids that are NULL.
NO_ID = -1

#: What is known of an id. Times are microseconds; spans up to ``done`` have been walked.
LAST = {"id": object, "status": object, "first": "int64", "ts": "int64", "ended": bool, "overdue": bool, "done": "int64"}


def _packed(frame: pd.DataFrame) -> tuple[bytes]:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: Sequence[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value[0])).read_all().to_pandas()


class StatusProcessor(StatefulProcessor):
    def __init__(self, span_ms: int, terminal: Sequence[str], timeout_ms: int | None, changes: bool):
        self.span_ms, self.terminal, self.timeout_ms, self.changes = span_ms, list(terminal), timeout_ms, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.open = handle.getMapState("open", "span long", "pieces long")
        self.pieces = handle.getMapState("pieces", "span long, piece long", "rows binary")

    def known(self) -> pd.DataFrame:
        return _unpacked(self.last.get()) if self.last.exists() else pd.DataFrame(columns=list(LAST)).astype(LAST)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Rows without a bucket only move the watermark on.
        last = None if pd.isna(key[0]) else self.known()
        for frame in rows:
            if last is None:
                continue
            spans = frame["ts"] // (self.span_ms * 1000)
            walked = spans <= frame["id"].map(dict(zip(last["id"], last["done"]))).astype("float64")
            late = frame[walked]
            if len(late):
                yield self.result(key, "late", late["id"], late["status"], late["ts"], late["sequence"])
            fresh = frame.loc[~walked, ["id", "ts", "sequence", "status"]]
            for span, part in fresh.groupby(spans[~walked], sort=True):
                self.keep(int(span), part)

    def keep(self, span: int, part: pd.DataFrame) -> None:
        count = self.open.getValue((span,))[0] if self.open.containsKey((span,)) else 0
        self.pieces.updateValue((span, count), _packed(part))
        self.open.updateValue((span,), (count + 1,))
        if not count:
            self.handle.registerTimer((span + 1) * self.span_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        span = at // self.span_ms - 1
        before = last = self.known()
        told, found = np.zeros(len(last), dtype=bool), None
        if at % self.span_ms == 0 and self.open.containsKey((span,)):
            last, told, found = self.walk(span, last)
        if self.timeout_ms is not None:
            deadline = self.deadlines(last)
            due = ~last["overdue"].to_numpy() & ((deadline <= at) | (deadline < timerValues.getCurrentWatermarkInMs()))
            last = last.assign(overdue=last["overdue"].to_numpy() | due)
            told = told | due
            # The earliest deadline has a timer; the others get theirs when it has fired.
            if (first := self.earliest(last)) not in (None, self.earliest(before)):
                self.handle.registerTimer(first)
            if told.any():
                yield self.summary(key, last[told])
        if told.any():
            self.last.update(_packed(last))
        if self.changes and found is not None and len(found):
            yield self.result(key, "change", found["id"], found["status"], found["ts"], found["sequence"], found["previous"])

    def deadlines(self, last: pd.DataFrame) -> np.ndarray:
        """The first millisecond after the time allowed."""
        return (last["first"].to_numpy() + self.timeout_ms * 1000) // 1000 + 1

    def earliest(self, last: pd.DataFrame) -> int | None:
        open_ = self.deadlines(last)[~last["overdue"].to_numpy()]
        return int(open_.min()) if len(open_) else None

    def walk(self, span: int, last: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
        """The rows of a span in order: the new table, which of its ids had rows, and changes of status."""
        count = self.open.getValue((span,))[0]
        rows = pd.concat([_unpacked(self.pieces.getValue((span, n))) for n in range(count)], ignore_index=True)
        for n in range(count):
            self.pieces.removeKey((span, n))
        self.open.removeKey((span,))
        code, ids = pd.factorize(rows["id"])
        order = np.lexsort((rows["sequence"].to_numpy(), rows["ts"].to_numpy(), code))
        rows, code = rows.iloc[order].reset_index(drop=True), code[order]
        ts = rows["ts"].to_numpy()
        place = pd.Index(last["id"]).get_indexer(ids)
        seen = place >= 0
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])

        # NULL is a status like others and has the number -1; -2 is none yet.
        number, names = pd.factorize(np.r_[rows["status"].to_numpy(object), last["status"].to_numpy(object)])
        names = np.r_[names, np.array([None, None], dtype=object)]
        status, known = number[: len(rows)], np.r_[number[len(rows) :], -2]
        previous = np.r_[-2, status[:-1]]
        previous[starts] = known[place]

        # Nothing follows a terminal status, so what counts of an id is its first rows.
        ends = rows["status"].isin(self.terminal).to_numpy()
        earlier = np.cumsum(ends) - ends
        over = np.r_[last["ended"].to_numpy(bool), False][place]
        live = ~over[code] & (earlier == earlier[starts][code])
        n_live = np.bincount(code, live, len(ids)).astype("int64")
        newest = np.where(n_live > 0, starts + n_live - 1, starts)

        def carried(column: str, new: np.ndarray, old: np.ndarray) -> np.ndarray:
            return np.where(old, np.r_[last[column].to_numpy("int64"), 0][place], new)

        none = n_live == 0
        after = pd.DataFrame({
            "id": ids,
            "status": names[np.where(none, known[place], status[newest])],
            "first": carried("first", ts[starts], seen),
            "ts": carried("ts", ts[newest], none),
            "ended": over | ends[newest],
            "overdue": np.r_[last["overdue"].to_numpy(bool), False][place],
            "done": span,
        })
        rest = last[~np.isin(np.arange(len(last)), place[seen])]
        changed = live & (status != previous)
        found = rows[changed].assign(previous=names[previous[changed]])
        table = pd.concat([rest, after], ignore_index=True) if len(rest) else after
        return table, np.arange(len(table)) >= len(rest), found

    def result(
        self, key: Any, kind: str, ids: pd.Series, status: pd.Series, ts: pd.Series, sequence: pd.Series,
        previous: pd.Series | None = None,
    ) -> pd.DataFrame:
        size = len(ts)
        numbers = [None if n == NO_SEQUENCE else n for n in sequence.tolist()]
        names, old = ([None if pd.isna(s) else s for s in c] if c is not None else [None] * size for c in (status, previous))
        columns = [self.named(key, ids), [kind] * size, names, pd.to_datetime(ts.to_numpy(), unit="us"), pd.array(numbers, "Int64"), old]
        nothing = [pd.Series([pd.NaT] * size, dtype="datetime64[us]")] * 2
        return pd.DataFrame(dict(zip(COLUMNS, [*columns, *nothing, pd.array([None] * size, "boolean")])))

    def named(self, key: Any, ids: pd.Series) -> list:
        return [None] * len(ids) if key[0] == NO_ID else ids.tolist()

    def summary(self, key: Any, last: pd.DataFrame) -> pd.DataFrame:
        size = len(last)
        status = ["unknown" if pd.isna(s) else s for s in last["status"]]
        first, ts = (pd.to_datetime(last[c].to_numpy(), unit="us") for c in ("first", "ts"))
        columns = [self.named(key, last["id"]), ["summary"] * size, status, ts, pd.array([None] * size, "Int64"), [None] * size, first, ts]
        timed_out = pd.array(last["overdue"].to_numpy() & ~np.isin(status, list(TERMINAL)), "boolean")
        return pd.DataFrame(dict(zip(COLUMNS, [*columns, timed_out])))

    def close(self) -> None:
        pass


def keyed_status(
    seen: DataFrame,
    delay: str,
    span_seconds: int = 3600,
    terminal: Sequence[str] = TERMINAL,
    timeout_minutes: int | None = None,
    changes: bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """What a stream of ``id, status, ts, sequence`` says of each id in the order of (ts, sequence).

    ``kind`` is ``change`` (a status that differs from the one before, ``previous``;
    the first of an id included), ``late`` (a row whose span was walked already:
    more than ``delay`` behind the newest row) or ``summary`` (with
    ``timeout_minutes``: first and last sighting, status and whether polling has
    run out, given anew whenever it may have changed; the last one counts).
    Nothing follows a terminal status. Answers come once the watermark has passed
    a span of ``span_seconds``; rows without an id only move the watermark on, as
    a poller that is alive but sees no news does (where ids are whole numbers they
    are also an id of their own). NULL is a status like others.

    Open spans lie in the state store piece by piece, so a micro-batch writes what
    it brings. Ids share ``buckets``: a closed span reads and writes one row for
    each id of its bucket, so give more buckets where there are millions of ids.
    Their number must stay the same over the life of a checkpoint.
    """
    span = span_seconds * 1000
    timed = seen.withColumn("_event", F.col("ts").cast("timestamp")).withWatermark("_event", delay)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = seen.schema["id"].dataType
    # Whole numbers stay such in pandas if none of them is NULL.
    id_ = F.coalesce("id", F.lit(0)).cast(kind) if isinstance(kind, T.IntegralType) else F.col("id")
    bucket = F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(buckets)))
    if isinstance(kind, T.IntegralType):
        bucket = F.coalesce(bucket, F.lit(NO_ID))
    bucket = F.when(F.col("ts").isNotNull(), bucket)
    # Without the watermark's column the operator sees late rows too.
    rows = timed.select(
        bucket.alias("_bucket"), id_.alias("id"), "status", F.coalesce(micros, F.lit(0)).alias("ts"),
        F.coalesce(F.col("sequence").cast("bigint"), F.lit(NO_SEQUENCE)).alias("sequence"),
    )
    processor = StatusProcessor(span, terminal, None if timeout_minutes is None else timeout_minutes * 60_000, changes)
    return rows.groupBy("_bucket").transformWithStateInPandas(processor, f"id {kind.simpleString()}, {RESULT}", "append", "EventTime")


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which this needs; a setting of the session is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def write_keyed(answers: DataFrame, out: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Write ``kind=…/epoch=…`` folders under ``out``: changes, late rows and summaries apart. An epoch that runs again replaces its own."""

    def apply(batch: DataFrame, epoch: int) -> None:
        (
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").partitionBy("kind", "epoch")
            .option("partitionOverwriteMode", "dynamic").parquet(out)
        )

    with rocks_state(answers.sparkSession):
        writer = answers.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_keyed(spark: SparkSession, out: str, id_type: str, kind: str) -> DataFrame:
    """The answers of one kind with their ``epoch``."""
    return spark.read.schema(f"id {id_type}, {RESULT}, epoch long").parquet(out).where(F.col("kind") == kind).drop("kind")


def last_summaries(summaries: DataFrame) -> DataFrame:
    """``id, first_seen, last_seen, final_status, timed_out`` from what ``read_keyed`` gives of summaries."""
    rest = ["first_seen", "last_seen", "status", "timed_out"]
    # Within an epoch a later sighting, then an overdue one, is the later word.
    order = F.struct("epoch", "last_seen", "timed_out")
    return (
        summaries.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_s"))
        .select("id", "_s.first_seen", "_s.last_seen", F.col("_s.status").alias("final_status"), "_s.timed_out")
    )
