"""Following batch status as a stream.

``status_change_stream`` keeps its state in Spark's state store and suits live
polling. ``follow_status`` keeps it as a small table per micro-batch and works in
blocks, so a micro-batch may be as large as a backlog and hold one very busy id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators.groups import join_to_one, latest_by
from inkwell.operators.tracking import TERMINAL, path_exists, status_changes
from inkwell.session import delete_path, scratch, written

STATE = "status string, ts timestamp, closed boolean"


def status_change_stream(
    seen: DataFrame, terminal: Sequence[str] = TERMINAL, timeout_minutes: int | None = None
) -> DataFrame:
    """Changes of ``id, status, ts`` as they happen: ``id, status, ts, previous``.

    The last status per id is kept as state. Rows older than it are dropped, and
    nothing follows a terminal status. With ``timeout_minutes`` an id that stays
    silent that long is closed with status ``unknown``.

    What one task sees of an id is its rows of one micro-batch, so size those at
    the source (``maxBytesPerTrigger`` or ``maxFilesPerTrigger``).
    """
    id_type = seen.schema["id"].dataType.simpleString()
    ended = frozenset(terminal)
    wait = timeout_minutes * 60_000 if timeout_minutes else None

    def follow(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, ts, closed = state.get if state.exists else (None, None, False)
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield pd.DataFrame({"id": [key[0]], "status": ["unknown"], "ts": [ts], "previous": [status]})
            return
        if not closed:
            rows = pd.concat([f[["status", "ts"]] for f in frames]).sort_values("ts", kind="stable")
            changes = []
            for new, at in rows.itertuples(index=False):
                if ts is not None and at < ts:
                    continue
                if new != status:
                    changes.append((key[0], new, at, status))
                status, ts = new, at
                if new in ended:
                    closed = True
                    break
            if ts is not None:
                state.update((status, ts.to_pydatetime() if hasattr(ts, "to_pydatetime") else ts, closed))
            if changes:
                yield pd.DataFrame(changes, columns=["id", "status", "ts", "previous"])
        if wait and not closed:
            state.setTimeoutDuration(wait)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return seen.select("id", "status", "ts").groupBy("id").applyInPandasWithState(
        follow, f"id {id_type}, status string, ts timestamp, previous string", STATE, "append", timeout
    )


def follow_status(
    seen: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    block: Column,
    terminal: Sequence[str] = TERMINAL,
    **trigger: Any,
) -> StreamingQuery:
    """Write changes of ``id, status, ts`` to ``out/epoch=N``, with ``previous``.

    The last row per id is kept in ``state/epoch=N``, one folder per micro-batch,
    of which the last two stay; only the newest is read. A micro-batch that runs again replaces its folders.
    ``block`` must not decrease with ``ts``.
    """

    def still_open(rows: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
        """Rows no older than what is known of their id, unless that was terminal."""
        last = known.select("id", F.col("status").alias("_status"), F.col("ts").alias("_ts"))
        follows = F.col("ts") >= F.col("_ts")
        if terminal:
            follows = follows & ~F.col("_status").isin(*terminal)
        return join_to_one(rows, last, ["id"], counts, "n").where(F.col("_ts").isNull() | follows)

    def until_end(rows: DataFrame, counts: DataFrame) -> DataFrame:
        """Rows up to the first terminal status of their id."""
        ends = rows.where(F.col("status").isin(*terminal)).groupBy("id").agg(F.min("ts").alias("_end"))
        return join_to_one(rows.select("id", "status", "ts"), ends, ["id"], counts, "n").where(
            F.col("_end").isNull() | (F.col("ts") <= F.col("_end"))
        )

    def apply(batch: DataFrame, epoch: int) -> None:
        with scratch(batch.sparkSession):
            follow(batch, epoch)
        # The state before the last is kept for this micro-batch, should it run again.
        if epoch > 1:
            delete_path(batch.sparkSession, f"{state}/epoch={epoch - 2}")

    def follow(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = written(batch.select("id", "status", "ts"), "seen")
        counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        before, known, live = f"{state}/epoch={epoch - 1}", None, rows
        if epoch > 0 and not path_exists(spark, before):
            raise RuntimeError(f"the state of epoch {epoch - 1} is missing in {state}; going on would repeat changes")
        if epoch > 0:
            known = spark.read.schema(rows.schema).parquet(before)
            live = still_open(live, counts, known)
        if terminal:
            live = until_end(live, counts)
        if live is not rows:
            live = written(live.select("id", "status", "ts"), "live")
        ordered, newest = live.withColumn("_new", F.lit(1)), live
        if known is not None:
            # What is known of an id stands ahead of its new rows.
            start = known.join(counts.select("id"), "id", "left_semi").withColumn("_new", F.lit(0))
            ordered, newest = ordered.unionByName(start), newest.unionByName(known)
        changes = status_changes(ordered, block, "id", ("ts", "_new")).where("_new = 1")
        changes.select("id", "status", "ts", "previous").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        latest_by(newest, "id", ["ts"]).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    writer = seen.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def on_status_change(
    changes: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, **trigger: Any
) -> StreamingQuery:
    """Hand each micro-batch of changes to ``callback``; its errors do not stop the stream."""

    def deliver(batch: DataFrame, epoch: int) -> None:
        try:
            callback(batch, epoch)
        except Exception as failure:
            print(f"status callback failed in epoch {epoch}: {type(failure).__name__}")

    writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(deliver).trigger(**(trigger or {"availableNow": True})).start()
