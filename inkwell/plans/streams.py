"""The streaming operators over the event table.

A query has to return a batch DataFrame, so each runs its stream over what is
there, with its own checkpoint, and reads back what was written.
"""

import math
from datetime import timedelta

from pyspark.sql import functions as F

from inkwell.operators.batch_table import read_batches
from inkwell.plans.answers import CHANGES_SQL, LATEST_SQL, ended, minute_of, shown
from inkwell.plans.registry import query, table
from inkwell.session import fresh_folder
from inkwell.streaming.arrivals import upsert_stream
from inkwell.streaming.keyed import keyed_status, last_summaries, read_keyed, write_keyed
from inkwell.streaming.rates import current_usage, rate_usage_stream, write_updates
from inkwell.streaming.status import follow_status, on_status_change, status_change_stream

# Bounds what one task can see of one id in a micro-batch.
BYTES_PER_TRIGGER = 4 * 1024**3


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # Written as a pattern, the path may be one file as well as a folder of files.
    return (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
        .parquet(f"{sf_dir}/[e]vents.parquet")
    )


def _seen(spark, sf_dir):
    return event_stream(spark, sf_dir).select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts")
    )


def _read_changes(spark, path):
    rows = spark.read.parquet(path).select("id", "status", "ts", "previous")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"select id, status, ts, previous from ({CHANGES_SQL})")
def stream_status_changes(spark, sf_dir):
    out, state, checkpoint = [fresh_folder(spark, n) for n in ("changes", "state", "checkpoint")]
    follow_status(_seen(spark, sf_dir), out, state, checkpoint, minute_of(), terminal=()).awaitTermination()
    return _read_changes(spark, out)


#: Length of a span of the keyed state: answers here come at the end anyway, so few spans serve.
WEEK = 7 * 86_400
#: Slices of the event time in the order in which their files come, and how many of them the disorder spans.
SLICES, DISORDER = (1, 0, 3, 2), 2


def _range_of(spark, sf_dir):
    """First and last event time, and the delay that the disorder asks for, in seconds."""
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    return first, last, math.ceil((last - first).total_seconds() / len(SLICES) * DISORDER) + 60 if last else 60


def out_of_order(spark, sf_dir, *columns, until=None):
    """Events as a stream of files out of time order; a last one moves the clock to ``until``.

    A trigger takes about as many files as a slice has, so that triggers do not
    become more as a larger table is written in more files.
    """
    folder, events = fresh_folder(spark, "arriving"), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last, _ = _range_of(spark, sf_dir)
    micros = F.unix_micros("ts")
    bounds = events.select(F.min(micros), F.max(micros)).first()
    slice_ = F.least(F.floor((micros - bounds[0]) * len(SLICES) / F.lit(max(1, (bounds[1] or 0) - (bounds[0] or 0)))), F.lit(len(SLICES) - 1))
    rows = events.select(*columns)
    for n in SLICES:
        events.where(slice_ == n).select(*columns).write.parquet(f"{folder}/{n}")
    if until is not None:
        clock = spark.createDataFrame([(until,)], "ts timestamp")
        clock.select(*[F.col("ts") if c.name == "ts" else F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema]).write.parquet(f"{folder}/clock")
    files = len(spark.read.schema(rows.schema).parquet(*[f"{folder}/{n}" for n in SLICES]).inputFiles())
    per_trigger = max(1, math.ceil(files / len(SLICES)))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/*")


@query(f"select id, status, ts, previous from ({CHANGES_SQL})")
def stream_status_live(spark, sf_dir):
    """The same in the order of event time, over files out of that order."""
    _, last, delay = _range_of(spark, sf_dir)
    columns = [
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts"), F.col("event_id").alias("sequence")
    ]
    seen = out_of_order(spark, sf_dir, *columns, until=last + timedelta(seconds=delay + 2 * WEEK))
    out, checkpoint = fresh_folder(spark, "changes"), fresh_folder(spark, "checkpoint")
    write_keyed(keyed_status(seen, f"{delay} seconds", WEEK, terminal=()), out, checkpoint).awaitTermination()
    changes = read_keyed(spark, out, "long", "change")
    return changes.select("id", "status", F.col("ts").cast("timestamp_ntz").alias("ts"), "previous")


@query(
    """with clock as (select max(ts) + interval 8 day as as_of from events),
       last as (select user_id as id, min(ts) over (partition by user_id) as first_seen, ts as last_seen, event_type as final_status
                from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
       select id, first_seen, last_seen, final_status, final_status not in ('purchase', 'signup')
              and date_diff('microsecond', first_seen, as_of) > 36 * 86400000000::bigint as timed_out from last, clock"""
)
def stream_poll_timeout(spark, sf_dir):
    """Deadlines as timers; eight days after the last event the clock stands still. Purchase and signup stand for terminal statuses."""
    _, last, delay = _range_of(spark, sf_dir)
    columns = [
        F.col("user_id").alias("id"), ended("event_type").alias("status"), F.col("ts"), F.col("event_id").alias("sequence")
    ]
    seen = out_of_order(spark, sf_dir, *columns, until=last + timedelta(days=8, seconds=delay))
    out, checkpoint = fresh_folder(spark, "polls"), fresh_folder(spark, "checkpoint")
    polled = keyed_status(seen, f"{delay} seconds", WEEK, terminal=(), timeout_minutes=36 * 1440, changes=False)
    write_keyed(polled, out, checkpoint).awaitTermination()
    found = last_summaries(read_keyed(spark, out, "long", "summary"))
    return found.select(
        "id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], shown("final_status").alias("final_status"),
        "timed_out",
    )


@query(f"select cast(user_id as varchar) as id, event_type as status, 0::bigint as request_count from ({LATEST_SQL})")
def stream_new_batches(spark, sf_dir):
    """Files out of time order, each a segment of the table; the last version of an id counts."""
    columns = [
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.lit(None).cast("string").alias("model"),
        F.lit(0).cast("bigint").alias("request_count"),
        F.col("ts").cast("string").alias("last_updated"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col("event_id"),
    ]
    updates = out_of_order(spark, sf_dir, *columns)
    out, checkpoint = fresh_folder(spark, "tracked"), fresh_folder(spark, "checkpoint")
    upsert_stream(updates, out, ["created_at", "event_id"], checkpoint).awaitTermination()
    return read_batches(spark, out).select("id", "status", "request_count")


@query(
    """select date_trunc('minute', ts) as minute, cast(sum(event_id * 7919 % 30000 + 1) as bigint) as tokens,
              count(*) as requests, sum(event_id * 7919 % 30000 + 1) > 60000 or count(*) > 3000 as over_limit
       from events group by 1"""
)
def stream_rate_usage(spark, sf_dir):
    asked = event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 30000 + 1).alias("tokens")
    )
    out, checkpoint = fresh_folder(spark, "rates"), fresh_folder(spark, "checkpoint")
    # Files of a backlog come in no time order, so nothing may count as late here.
    write_updates(rate_usage_stream(asked, delay=None), out, checkpoint).awaitTermination()
    return current_usage(spark, out).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(f"select id, status, ts, previous from ({CHANGES_SQL})")
def status_callback(spark, sf_dir):
    """The callback keeps each change that it is handed."""
    out, checkpoint = fresh_folder(spark, "told"), fresh_folder(spark, "checkpoint")

    def told(changes, epoch):
        changes.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    on_status_change(status_change_stream(_seen(spark, sf_dir), terminal=()), told, checkpoint).awaitTermination()
    return _read_changes(spark, out)
