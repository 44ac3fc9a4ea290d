"""Running prompts through a completion function the caller supplies."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import or_
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.answers import RETRY_STATUS
from inkwell.functions.text import words
from inkwell.operators.chunking import chunk_words
from inkwell.operators.documents import merge_chunks
from inkwell.operators.groups import SEGMENT_CHARS, block_of
from inkwell.operators.limits import budget_cutoff
from inkwell.session import delete_path, fresh_folder, path_exists, written

OUTCOME = (
    "response string, error string, id string, success boolean, status_code int, attempts int"
)

#: Dollars of an outcome; sums of it are exact.
MONEY = "decimal(28,12)"

# Fixed value: calls that the service's client keeps open.
IN_FLIGHT = 5

#: Prompts of a staged file, and of a wave unless there are so many that they would make more than ``WAVES`` of them.
WAVE, WAVES = 10_000, 64
#: Outcomes of a task are kept as soon as it is through, also if the wave is not.
KEEP_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

Completion = Callable[[str], Mapping[str, Any]]


class CompletionError(Exception):
    """What a completion function raises for a response that is not a success."""

    def __init__(self, message: str, status_code: int | None = None) -> None:
        super().__init__(message)
        self.status_code = status_code


def _one(complete: Completion, prompt: str, max_retries: int, base_delay: float) -> dict[str, Any]:
    attempt = 0
    while True:
        try:
            answer = complete(prompt)
            return {
                "response": answer.get("content"), "error": None, "id": answer.get("id"),
                "success": True, "status_code": 200, "attempts": attempt + 1,
            }
        except Exception as failure:  # a row ends as an error, it never fails the task
            status = getattr(failure, "status_code", None)
            if status not in RETRY_STATUS or attempt >= max_retries:
                return {
                    "response": None, "error": str(failure), "id": None,
                    "success": False, "status_code": status, "attempts": attempt + 1,
                }
        # Up to half as long again, so that calls refused together do not come back together.
        time.sleep(base_delay * 2**attempt * random.uniform(1.0, 1.5))
        attempt += 1


def map_completions(
    prompts: DataFrame,
    factory: Callable[[], Completion],
    prompt: str = "prompt",
    max_retries: int = 3,
    base_delay: float = 1.0,
    partitions: int | None = None,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Add the outcome of each prompt. ``factory`` makes one client per partition.

    A task keeps ``in_flight`` calls open, so the client must allow calls from
    several threads, and hands on outcomes as they come in small groups;
    ``partitions`` bounds how many tasks run at once. A task that runs again
    repeats its calls: ``complete_into`` keeps what is done.
    """
    if partitions:
        prompts = prompts.repartition(partitions)
    columns = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = factory()
        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                for at in range(0, len(frame), 8 * in_flight):
                    part = frame.iloc[at : at + 8 * in_flight].reset_index(drop=True)
                    done = list(pool.map(lambda p: _one(complete, p, max_retries, base_delay), part[prompt]))
                    outcome = pd.DataFrame(done, columns=[f.split()[0] for f in OUTCOME.split(", ")], dtype=object)
                    yield pd.concat([part, outcome], axis=1)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{types}, {OUTCOME}").select(*columns, *[f.split()[0] for f in OUTCOME.split(", ")])


def complete_into(
    prompts: DataFrame,
    path: str,
    factory: Callable[[], Completion],
    keys: Sequence[str] = ("batch_id", "custom_id"),
    waves: int = 8,
    again: Column | None = None,
    **options: Any,
) -> DataFrame:
    """Outcomes of all prompts from the store at ``path``, calling only those without one.

    Prompts go in ``waves`` by the hash of their keys, each appended to the store
    when it is through, so a run that stops repeats at most a wave. ``again``, a
    condition on stored outcomes, says which are to be called once more; of
    several outcomes of a key a success counts before a failure.
    """
    spark = prompts.sparkSession
    schema = T.StructType([*prompts.schema.fields, *T.StructType.fromDDL(OUTCOME).fields])

    def stored() -> DataFrame | None:
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else None

    for wave in range(waves):
        open_ = prompts.where(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave)
        before = stored()
        if before is not None:
            done = before if again is None else before.where(~F.coalesce(again, F.lit(False)))
            open_ = open_.join(done.select(*keys), list(keys), "left_anti")
        map_completions(open_, factory, **options).write.mode("append").parquet(path)
    rest = [c for c in schema.names if c not in keys]
    kept = stored().groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("success", "attempts")).alias("_row"))
    return kept.select(*keys, "_row.*").select(*schema.names)


@dataclass(frozen=True)
class Completed:
    """Outcomes so far, what they cost, and whether the spend limit ended the run."""

    outcomes: DataFrame
    spent: Decimal
    stopped: bool


class _LimitReached(Exception):
    pass


def stage_prompts(prompts: DataFrame, store: str, keys: Sequence[str], wave_size: int) -> tuple[int, int]:
    """Write prompts that the store does not have yet, once, in files of at most ``wave_size``; how many files there are, and rows in the largest.

    A key that is NULL or given twice is refused: its outcome could not be told.
    """
    spark, folder = prompts.sparkSession, f"{store}/_prompts"

    def check(rows: DataFrame) -> None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if not counts.where((F.col("_n") > 1) | reduce(or_, [F.col(k).isNull() for k in keys])).isEmpty():
            raise ValueError(f"prompts need keys {', '.join(keys)} that are not NULL and differ")

    def staged() -> DataFrame:
        return spark.read.schema(prompts.schema).parquet(folder)

    new, first = prompts, not path_exists(spark, f"{folder}/_checked")
    if first:
        delete_path(spark, folder)  # of a run that died before its prompts were checked
    else:
        new = written(prompts, "prompts")
        check(new)
        new = new.join(staged().select(*keys), list(keys), "left_anti")
    new.write.mode("append").option("maxRecordsPerFile", wave_size).parquet(folder)
    if first:
        check(staged())
        spark.createDataFrame([(True,)], "ok boolean").coalesce(1).write.parquet(f"{folder}/_checked")
    found = staged().groupBy(F.col("_metadata.file_path")).count().agg(F.count(F.lit(1)), F.max("count")).first()
    return found[0], found[1] or 1


def complete_in_waves(
    prompts: DataFrame,
    store: str,
    factory: Callable[[], Completion],
    keys: Sequence[str] = ("batch_id", "custom_id"),
    wave_size: int | None = None,
    budget: float | Decimal | None = None,
    cost: Column | None = None,
    most: Column | None = None,
    **options: Any,
) -> Completed:
    """Outcomes of all prompts, kept in ``store``; a later run goes on where this one ends.

    Prompts are written once and then streamed in files: so many files as have at
    most ``wave_size`` prompts are a wave, and the stream's checkpoint is the
    cursor. Without a size it is ``WAVE``, or what makes ``WAVES`` waves where that
    is more and neither a budget nor ``partitions`` asks for small ones; a task
    has the fewer prompts then. What a task has done is kept when it is through, so
    a run that stops repeats at most the calls of tasks that were open. Prompts
    that a later run brings in addition are appended.

    With a ``budget`` calls stop once it is spent. ``cost`` is what an outcome
    cost, ``most`` the most that a prompt can cost, each over the columns at hand.
    A wave calls as many prompts as fit if all cost the most, adds up what they
    did cost and goes on with the rest, so the limit is passed by one call at
    most. A later run with a larger budget calls the rest.
    """
    spark = prompts.sparkSession
    schema = T.StructType([*prompts.schema.fields, *T.StructType.fromDDL(f"{OUTCOME}, cost {MONEY}").fields])
    price = F.lit(0) if cost is None else F.coalesce(cost, F.lit(0))
    limit = None if budget is None else Decimal(str(budget))
    slots = spark.sparkContext.defaultParallelism
    asked = options.pop("partitions", None)
    reached = []
    staged_files, largest = stage_prompts(prompts, store, keys, wave_size or WAVE)
    files = max(1, (wave_size or WAVE) // largest)
    if wave_size is None and limit is None and not asked:
        files = max(files, -(-staged_files // WAVES))
    tasks = asked or max(slots, -(-files * largest * slots // WAVE))

    def outcomes(path: str) -> DataFrame | None:
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else None

    def spent_in(path: str) -> Decimal:
        rows = outcomes(path)
        return Decimal(0) if rows is None else rows.agg(F.sum("cost")).first()[0] or Decimal(0)

    def call(open_: DataFrame, own: str) -> str:
        path = f"{own}/round={uuid.uuid4().hex}"
        called = map_completions(open_, factory, partitions=tasks, **options).withColumn("cost", price.cast(MONEY))
        called.write.options(**KEEP_TASKS).parquet(path)
        return path

    # Of all earlier runs; this one adds what its rounds cost.
    spent = Decimal(0) if limit is None else spent_in(store)

    def wave(batch: DataFrame, epoch: int) -> None:
        nonlocal spent
        own = f"{store}/epoch={epoch}"
        while True:
            done = outcomes(own)
            open_ = batch if done is None else batch.join(done.select(*keys), list(keys), "left_anti")
            if limit is None:
                call(open_, own)
                break
            if open_.isEmpty():
                break
            if spent >= limit:
                reached.append(epoch)
                raise _LimitReached
            rows = open_.withColumn("_most", F.coalesce(most if most is not None else F.lit(None), F.lit(limit)).cast(MONEY))
            # A wave is one block of at most wave_size rows.
            open_ = budget_cutoff(rows, [], keys, "_most", limit - spent, F.lit(0)).where("admitted").select(*batch.columns)
            spent += spent_in(call(open_, own))

    staged = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", files).parquet(f"{store}/_prompts")
    writer = staged.writeStream.option("checkpointLocation", f"{store}/_checkpoint").foreachBatch(wave)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException:
        if not reached:
            raise
    found = outcomes(store)
    if found is None:
        found = spark.createDataFrame([], schema)
    return Completed(found, found.agg(F.sum("cost")).first()[0] or Decimal(0), bool(reached))


def document_responses(
    documents: DataFrame,
    factory: Callable[[], Completion],
    max_words: int = 2000,
    overlap: int = 50,
    store: str | None = None,
    segment_chars: int = SEGMENT_CHARS,
    **options: Any,
) -> DataFrame:
    """Documents in, merged answers out: chunk, complete, keep, merge.

    Documents are cut up once. Outcomes are kept by ``doc_id, chunk_index`` in the
    folder ``store``, from which a later run goes on; by default in a new one of
    the shared folder. ``options`` are those of ``complete_in_waves``, a spend
    limit among them; what was not called is not in the text.
    """
    chunks = chunk_words(documents.select("doc_id", "text"), max_words, overlap)
    done = complete_in_waves(
        chunks.withColumnRenamed("content", "prompt"),
        store or fresh_folder(documents.sparkSession, "answers"),
        factory,
        keys=("doc_id", "chunk_index"),
        **options,
    )
    return merge_chunks(
        done.outcomes, ["doc_id"], ["chunk_index"], F.col("response"), block_of("chunk_index"), segment_chars
    )


def request_tokens(prompt, max_tokens: int = 500):
    """What a request counts for against the rate limits: its words plus the answer's limit."""
    return (F.size(words(prompt)) + max_tokens).cast("bigint")
