"""Results, scoring, batch tracking and reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import times
from inkwell.functions.answers import parse_structured
from inkwell.functions.evaluation import scored
from inkwell.operators import results, tracking
from inkwell.operators.groups import latest_by
from inkwell.plans.registry import (
    BATCHES_SQL,
    CHILDREN_SQL,
    MODELS,
    PRICED_SQL,
    documents,
    flat_errors,
    flat_results,
    pick,
    pick_sql,
    query,
    source_batches,
    spread_documents,
    table,
)
from inkwell.schemas import ERROR_LINE
from inkwell.sources.files import recent_rows

WITH = f"with {BATCHES_SQL}, {CHILDREN_SQL}"


NO_CHOICES = "array<struct<message:struct<role:string,content:string>>>"


# -- result lines --------------------------------------------------------------


def _result_lines(spark, sf_dir):
    """Turns as JSON result lines: some without usage, some without an answer."""
    answer = F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))
    usage = F.struct(
        F.length("text").cast("bigint").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"),
        (F.length("text") + F.col("turn")).cast("bigint").alias("total_tokens"),
    )
    line = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"),
        F.lit("completed").alias("status"),
        pick(MODELS, F.col("conv_id")).alias("model"),
        F.when(F.col("turn") % 3 != 2, usage).alias("usage"),
        F.when(F.col("turn") % 4 != 3, F.array(answer)).otherwise(F.array().cast(NO_CHOICES)).alias("choices"),
    )
    return table(spark, sf_dir, "conversations").select(F.to_json(line).alias("value"))


FLAT_LINES_SQL = f"""
select conv_id || '-' || turn as custom_id, 'completed' as status, '' as created_at,
       case when turn % 3 <> 2 then length(text) else 0 end as input_tokens,
       case when turn % 3 <> 2 then turn else 0 end as output_tokens, 0::bigint as reasoning_tokens,
       case when turn % 3 <> 2 then length(text) + turn else 0 end as total_tokens,
       {pick_sql(MODELS, "conv_id")} as model,
       case when turn % 4 = 3 then '' else text end as content,
       case when turn % 4 = 3 then null else role end as role
from conversations"""


@query(FLAT_LINES_SQL)
def flatten_results(spark, sf_dir):
    return results.flatten_results(results.parse_lines(_result_lines(spark, sf_dir)))


@query(f"select custom_id, content, input_tokens, output_tokens, reasoning_tokens, total_tokens from ({FLAT_LINES_SQL})")
def result_view(spark, sf_dir):
    return results.result_view(results.flatten_results(results.parse_lines(_result_lines(spark, sf_dir))))


@query(
    """select cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
              cast(sum(reasoning_tokens) as bigint) as reasoning_tokens, cast(sum(total_tokens) as bigint) as total_tokens
       from (""" + FLAT_LINES_SQL + ")"
)
def token_totals(spark, sf_dir):
    return results.token_totals(results.flatten_results(results.parse_lines(_result_lines(spark, sf_dir))))


def _error_lines(spark, sf_dir):
    error = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("type"),
        F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("message"),
    )
    line = F.struct(
        F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("custom_id"),
        F.when(F.col("event_id") % 11 != 0, error).alias("error"),
    )
    return table(spark, sf_dir, "events").select(F.to_json(line).alias("value"))


ERRORS_SQL = """
select case when event_id % 7 <> 0 then cast(event_id as varchar) else 'Unknown' end as custom_id,
       case when event_id % 11 <> 0 and event_id % 3 <> 0 then event_type else 'Unknown' end as error_type,
       case when event_id % 11 <> 0 and event_id % 5 <> 0 then props else 'Unknown' end as error_message
from events"""


@query(ERRORS_SQL)
def flatten_errors(spark, sf_dir):
    return results.flatten_errors(results.parse_lines(_error_lines(spark, sf_dir), ERROR_LINE))


@query(
    f"""select 'result' as kind, custom_id, content, null as error_type from ({FLAT_LINES_SQL})
        union all select 'error', custom_id, null, error_type from ({ERRORS_SQL})"""
)
def batch_outcomes(spark, sf_dir):
    lines = results.parse_lines(_result_lines(spark, sf_dir))
    errors = results.parse_lines(_error_lines(spark, sf_dir), ERROR_LINE)
    return results.outcomes(lines, errors).select("kind", "custom_id", "content", "error_type")


@query(
    """select custom_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then '{"summary":1}'
                         else text end as content
       from (select doc_id, cast(doc_id as varchar) as custom_id, text from documents)"""
)
def parse_result_lines(spark, sf_dir):
    """A third are structured answers, a third fail the check, a third are plain text."""
    points = F.array(F.lit("a"), F.lit("b"))
    content = (
        F.when(
            F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("summary"), points.alias("key_points")))
        )
        .when(F.col("doc_id") % 3 == 1, F.lit('{"summary":1}'))
        .otherwise(F.col("text"))
    )
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    line = F.struct(
        F.col("doc_id").cast("string").alias("custom_id"), F.array(F.struct(message.alias("message"))).alias("choices")
    )
    lines = spread_documents(spark, sf_dir).select(F.to_json(line).alias("value"))
    return results.parse_result_lines(lines).select("custom_id", "content")


# One answer per shape: only the first and the one with no key points are valid.
SHAPES = (
    '{"summary": %s, "key_points": ["a", "b"]}', '{"summary": 1, "key_points": ["a"], "x": %s}', '{"summary": %s}',
    "not json %s", '{"summary": %s, "key_points": [1]}', '{"summary": %s, "key_points": "a"}',
    '{"summary": %s, "key_points": ["a", null]}', '{"summary": %s, "key_points": []}',
    '{"summary": %s, "key_points": [null]}', "[%s]", '{"summary": %s, "key_points": ["a", 1]}',
)


@query(
    f"""select doc_id, valid, case when valid then j ->> '$.summary' end as summary,
               case when valid then cast(json_array_length(j, '$.key_points') as int) end as points,
               case when not json_valid(j) then 'Invalid JSON'
                    when not valid then 'Response does not match schema' end as error
        from (select doc_id, j, coalesce(json_valid(j) and json_type(t) = 'OBJECT' and json_type(t, '$.summary') = 'VARCHAR'
                and json_type(t, '$.key_points') = 'ARRAY'
                and len(list_filter(json_extract(t, '$.key_points[*]'), lambda p: json_type(p) <> 'VARCHAR')) = 0, false) as valid
              from (select doc_id, j, case when json_valid(j) then j::json end as t
                    from (select doc_id, replace({pick_sql(SHAPES, "doc_id")}, '%s', to_json(text)::varchar) as j
                          from documents)))"""
)
def structured_responses(spark, sf_dir):
    # An array of one string is the shortest way to a JSON string literal.
    literal = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    content = F.replace(pick(SHAPES, F.col("doc_id")), F.lit("%s"), literal)
    checked = spread_documents(spark, sf_dir).select("doc_id", parse_structured(content).alias("r"))
    return checked.select(
        "doc_id", "r.valid", "r.summary", F.size("r.key_points").alias("_n"), "r.error"
    ).select("doc_id", "valid", "summary", F.when(F.col("valid"), F.col("_n")).alias("points"), "error")


# -- scoring -------------------------------------------------------------------

KEYWORDS = ("the", "WITH", "nicht", "que")


@query(
    f"""select doc_id, found = 4 as passed, found / 4.0::double as score, 'found ' || found || '/4 keywords' as details
        from (select doc_id, {" + ".join(f"cast(contains(lower(text), '{k.lower()}') as int)" for k in KEYWORDS)} as found
              from documents)"""
)
def eval_keyword(spark, sf_dir):
    verdict = scored("keyword", F.col("text"), {"keywords": KEYWORDS})
    return spread_documents(spark, sf_dir).select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query(
    r"""select doc_id, hit as passed, cast(hit as double) as score, 'pattern=[0-9]{2,}|\.\n' as details
        from (select doc_id, regexp_matches(text, '[0-9]{2,}|\.\n') as hit from documents)"""
)
def eval_regex(spark, sf_dir):
    verdict = scored("regex", F.col("text"), {"pattern": r"[0-9]{2,}|\.\n"})
    return spread_documents(spark, sf_dir).select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query(
    """select doc_id, length(text) between 100 and 3000 as passed, cast(length(text) as double) as score,
              'length=' || length(text) as details from documents"""
)
def eval_length(spark, sf_dir):
    verdict = scored("length", F.col("text"), {"min_length": 100, "max_length": 3000})
    return documents(spark, sf_dir).select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


# -- batches -------------------------------------------------------------------


def _order_batches(spark, sf_dir):
    status = (
        F.when(F.col("o_orderstatus") == "O", "in_progress").when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "failed")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), status.alias("status"),
        F.col("o_orderdate").cast("string").alias("created_at"), "o_orderdate",
    )


@query(
    """select count(*) as total_batches, count(*) filter (o_orderstatus = 'O') as in_progress,
              count(*) filter (o_orderstatus = 'F') as completed, count(*) filter (o_orderstatus = 'P') as failed,
              count(*) filter (o_orderstatus not in ('O', 'F', 'P')) as other_status from orders"""
)
def batch_stats(spark, sf_dir):
    return tracking.batch_stats(_order_batches(spark, sf_dir))


@query(
    """select cast(o_orderkey as varchar) as id from orders
       where o_orderdate >= timestamp '1998-08-02 00:00:00' - interval 30 day"""
)
def prune_batches(spark, sf_dir):
    as_of = F.lit("1998-08-02 00:00:00Z").cast("timestamp")
    return tracking.prune_batches(_order_batches(spark, sf_dir), as_of).select("id")


@query(
    WITH + """
select b.id, b.status, b.created_at, b.model, b.request_count, coalesce(r.n, 0) as results, coalesce(e.n, 0) as errors
from batches b left join (select batch_id, count(*) as n from results group by 1) r on r.batch_id = b.id
left join (select batch_id, count(*) as n from errors group by 1) e on e.batch_id = b.id"""
)
def batch_listing(spark, sf_dir):
    return tracking.batch_listing(source_batches(spark, sf_dir), flat_results(spark, sf_dir), flat_errors(spark, sf_dir))


SUMMARY_SQL = WITH + f""",
priced as (
  select batch_id, input_tokens, output_tokens, reasoning_tokens, {PRICED_SQL.format(m="model")} from results
),
sums as (
  select batch_id, count(*) as results, cast(sum(input_tokens) as bigint) as input_tokens,
         cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(reasoning_tokens) as bigint) as reasoning_tokens,
         cast(sum(input_tokens * input_price + output_tokens * output_price + reasoning_tokens * reasoning_price)
              as double) / 1e6 as cost
  from priced group by 1
),
counted as (select batch_id, count(*) as errors from errors group by 1),
summary as (
  select id, status, replace(replace(created_at, 'T', ' '), 'Z', '') as created, model,
         coalesce(results, 0) as results, coalesce(errors, 0) as errors,
         coalesce(input_tokens, 0) as input_tokens, coalesce(output_tokens, 0) as output_tokens,
         coalesce(reasoning_tokens, 0) as reasoning_tokens, coalesce(cost, 0) as cost,
         case when coalesce(results, 0) + coalesce(errors, 0) > 0
              then coalesce(results, 0)::double / (coalesce(results, 0) + coalesce(errors, 0)) * 100 else 0 end as success_rate,
         coalesce(input_tokens + output_tokens + reasoning_tokens, 0) as summed_tokens
  from batches left join sums s on s.batch_id = id left join counted c on c.batch_id = id
)
"""


def _summary(spark, sf_dir):
    return tracking.batch_summary(
        source_batches(spark, sf_dir), flat_results(spark, sf_dir), flat_errors(spark, sf_dir)
    )


@query(SUMMARY_SQL + "select * from summary")
def batch_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    SUMMARY_SQL + """
select id, 'Status: ' || status || chr(10) || 'Created: ' || created || chr(10) || 'Model: ' || model || chr(10)
  || 'Results: ' || results || chr(10) || 'Errors: ' || errors || chr(10)
  || 'Success Rate: ' || format('{:.1f}', success_rate) || '%'
  || case when results > 0 then chr(10) || 'Input Tokens: ' || format('{:,}', input_tokens) || chr(10)
       || 'Output Tokens: ' || format('{:,}', output_tokens) || chr(10) || 'Total Tokens: ' || format('{:,}', summed_tokens)
       || chr(10) || 'Estimated Cost: $' || format('{:.4f}', cost) else '' end as text
from summary"""
)
def batch_summary_text(spark, sf_dir):
    return tracking.summary_text(_summary(spark, sf_dir))


BY_MODEL_SQL = """by_model as (
  select model, count(*) as requests, count(*)::double / sum(count(*)) over () as share
  from (select b.model from results r join batches b on b.id = r.batch_id where b.status = 'completed') group by 1
)"""


@query(WITH + f", {BY_MODEL_SQL} select model, requests, share from by_model")
def requests_by_model(spark, sf_dir):
    return tracking.requests_by_model(source_batches(spark, sf_dir), flat_results(spark, sf_dir))


@query(
    WITH + f""", {BY_MODEL_SQL},
totals as (
  select cast(sum(input_tokens) as bigint) as i, cast(sum(output_tokens) as bigint) as o,
         cast(sum(reasoning_tokens) as bigint) as r
  from results r join batches b on b.id = r.batch_id where b.status = 'completed'
),
spread as (
  select model, requests, share, i * share as input_tokens, o * share as output_tokens, r * share as reasoning_tokens,
         {PRICED_SQL.format(m="model")} from by_model, totals
),
priced as (
  select model, requests, share, input_tokens, output_tokens, reasoning_tokens,
         input_tokens * input_price::double / 1e6 as input_cost, output_tokens * output_price::double / 1e6 as output_cost,
         reasoning_tokens * reasoning_price::double / 1e6 as reasoning_cost from spread
)
select *, input_cost + output_cost + reasoning_cost as total_cost from priced"""
)
def allocated_cost(spark, sf_dir):
    return tracking.allocated_cost(source_batches(spark, sf_dir), flat_results(spark, sf_dir))


@query(WITH + " select id, status, model from batches where status in ('in_progress', 'validating')")
def active_batches(spark, sf_dir):
    return tracking.active_batches(source_batches(spark, sf_dir)).select("id", "status", "model")


@query(
    WITH + """ select id, status, model from batches
           where status in ('completed', 'failed') and model in ('o1-pro', 'gpt-4-turbo', 'o3-mini')"""
)
def filter_batches(spark, sf_dir):
    kept = tracking.filter_batches(
        source_batches(spark, sf_dir), ("completed", "failed"), ("o1-pro", "gpt-4-turbo", "o3-mini")
    )
    return kept.select("id", "status", "model")


@query(WITH + " select id, status from batches where status in ('completed', 'failed', 'expired', 'cancelled')")
def terminal_batches(spark, sf_dir):
    return tracking.terminal_batches(source_batches(spark, sf_dir)).select("id", "status")


@query(WITH + " select id, status from batches where status = 'completed' and id in (select batch_id from results)")
def completed_with_results(spark, sf_dir):
    return tracking.completed_with_results(source_batches(spark, sf_dir), flat_results(spark, sf_dir)).select(
        "id", "status"
    )


@query(WITH + " select id, status, model, request_count from batches where id = 'src7'")
def batch_by_id(spark, sf_dir):
    return tracking.batch_by_id(source_batches(spark, sf_dir), "src7").select("id", "status", "model", "request_count")


@query(WITH + " select distinct model from batches")
def distinct_models(spark, sf_dir):
    return tracking.distinct_models(source_batches(spark, sf_dir))


def _event_updates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), "ts", "event_id"
    )


def _customer_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("status")
    )


LATEST_SQL = """select user_id, event_type, event_id from events
  qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"""


@query(LATEST_SQL)
def latest_by_id(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return latest_by(events, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    f"""select cast(user_id as varchar) as id, event_type as status from ({LATEST_SQL})
        union all select cast(c_custkey as varchar), c_mktsegment from customer
        where c_custkey not in (select user_id from events)"""
)
def upsert_batches(spark, sf_dir):
    return tracking.upsert_batches(
        _customer_rows(spark, sf_dir), _event_updates(spark, sf_dir), ["ts", "event_id"]
    )


@query(
    f"""select cast(c_custkey as varchar) as id, coalesce(event_type, c_mktsegment) as status,
               case when event_type is not null then '2024-02-01T00:00:00' end as last_updated
        from customer left join ({LATEST_SQL}) on user_id = c_custkey"""
)
def update_batches(spark, sf_dir):
    current = _customer_rows(spark, sf_dir).withColumn("last_updated", F.lit(None).cast("string"))
    now = F.lit("2024-02-01 00:00:00Z").cast("timestamp")
    return tracking.update_batches(current, _event_updates(spark, sf_dir), ["ts", "event_id"], now)


@query(
    """select cast(c_custkey as varchar) as id, c_mktsegment as status from customer
       where c_custkey not in (select user_id from events)"""
)
def delete_batches(spark, sf_dir):
    return tracking.delete_batches(_customer_rows(spark, sf_dir), _event_updates(spark, sf_dir))


@query("select cast(c_custkey as varchar) as id from customer union select cast(user_id as varchar) from events")
def all_batch_ids(spark, sf_dir):
    return tracking.all_batch_ids(_customer_rows(spark, sf_dir), _event_updates(spark, sf_dir))


@query("select cast(o_orderkey as varchar) as id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def detect_inputs(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    tracked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return tracking.untracked(files, tracked)


CHANGES_SQL = """
select user_id as id, ts, event_id, event_type as status, previous
from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
where previous is null or previous <> event_type"""


def minute_of(ts: str = "ts"):
    """Minutes as blocks of the time order."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(60))


@query(CHANGES_SQL)
def status_changes(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("status")
    )
    return tracking.status_changes(seen, None, "id", ("ts", "event_id"))


def ended(column: str) -> Column:
    """Purchase and signup stand for terminal statuses."""
    return F.when(F.col(column) == "purchase", "completed").when(F.col(column) == "signup", "failed").otherwise(F.col(column))


def shown(column: str) -> Column:
    return F.when(F.col(column) == "completed", "purchase").when(F.col(column) == "failed", "signup").otherwise(F.col(column))


@query(
    """select id, final_status, final_status not in ('purchase', 'signup')
              and date_diff('microsecond', first_seen, timestamp '2024-01-31 00:00:00') > 29 * 86400000000::bigint as timed_out
       from (select user_id as id, min(ts) as first_seen, max_by(event_type, ts) as final_status from events group by 1)"""
)
def poll_timeout(spark, sf_dir):
    """Purchase and signup stand for terminal statuses."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", ended("event_type").alias("status"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    timed = tracking.poll_timeouts(seen, as_of, timeout_minutes=29 * 1440)
    return timed.select("id", shown("final_status").alias("final_status"), "timed_out")


@query("select count(*) as files, cast(sum(n_chars) as bigint) as bytes, sum(n_chars) / 1048576.0::double as megabytes from documents")
def storage_usage(spark, sf_dir):
    return tracking.storage_usage(documents(spark, sf_dir).select(F.col("n_chars").alias("length")))


@query(
    """select event_id, user_id, ts from (select * from events where event_type = 'error'
       order by ts desc, event_id desc limit 100)"""
)
def recent_events(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return recent_rows(errors, ["ts", "event_id"], 100)


# -- times ---------------------------------------------------------------------

UNITS = ("s", "M", "h", "", "x")


@query(
    f"""select event_id, interval_text,
               case when right(lower(interval_text), 1) = 's' then event_id
                    when right(lower(interval_text), 1) = 'm' then event_id * 60
                    when right(lower(interval_text), 1) = 'h' then event_id * 3600 end as seconds
        from (select event_id, event_id || {pick_sql(UNITS, "event_id")} as interval_text from events)"""
)
def poll_intervals(spark, sf_dir):
    text = F.concat(F.col("event_id").cast("string"), pick(UNITS, F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("interval_text")).select(
        "event_id", "interval_text", times.poll_interval_seconds(F.col("interval_text")).alias("seconds")
    )


@query(
    """select event_id, case when event_id % 9 = 0 then 'N/A' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as shown,
              case when event_id % 9 = 0 then 'N/A'
                   else strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M:%S') end as shown_tokyo,
              case when event_id % 9 = 0 then 'Unknown'
                   else strftime(ts + to_minutes(event_id % 2000), '%Y-%m-%d %H:%M:%S') || ' UTC' end as completes
       from events"""
)
def time_formats(spark, sf_dir):
    stamp = F.when(
        F.col("event_id") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise("garbage")
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp")).select(
        "event_id",
        times.format_time(F.col("stamp")).alias("shown"),
        times.format_time(F.col("stamp"), zone="Asia/Tokyo").alias("shown_tokyo"),
        times.completion_time(F.col("stamp"), (F.col("event_id") % 2000).cast("int")).alias("completes"),
    )


@query(
    """select event_id, case when s < 60 then format('{:.1f}', s) || ' seconds'
                when s < 3600 then format('{:.1f}', s / 60) || ' minutes'
                else format('{:.1f}', s / 3600) || ' hours' end as elapsed
       from (select event_id, value * (event_id % 97) as s from events)"""
)
def elapsed_texts(spark, sf_dir):
    seconds = F.col("value") * (F.col("event_id") % 97)
    return table(spark, sf_dir, "events").select("event_id", times.elapsed_text(seconds).alias("elapsed"))


@query(
    """select o_orderkey, 'batch_' || cast(epoch(o_orderdate) as bigint) || '_' || left(md5(cast(o_orderkey as varchar)), 12) as id
       from orders"""
)
def stable_ids(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    made = times.stable_id("batch", times.parse_time(F.col("o_orderdate").cast("string")), key)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("id"))
