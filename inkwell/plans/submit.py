"""Cleaning, counting, de-duplicating, pricing and batching prompts."""

from pyspark.sql import functions as F

from inkwell.functions import pricing, text
from inkwell.functions.answers import classify_error, retry_delay, retryable
from inkwell.operators import dedup, limits, requests
from inkwell.operators.documents import archive_members
from inkwell.operators.groups import block_of, position_in_group
from inkwell.plans.registry import (
    FILENAME_SQL,
    MODEL_SQL,
    MODELS,
    PRICED_SQL,
    TOKENS_SQL,
    WORDS_SQL,
    documents,
    filename_of,
    model_of,
    pick,
    pick_sql,
    prompts,
    query,
    spread_documents,
    table,
)
from inkwell.sources.files import content_digest, extract_text

SANITIZE_SQL = (
    r"regexp_replace({c}, '[<>\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\p{{Cf}}\p{{Co}}\p{{Zl}}\p{{Zp}}\x{{a0}}\x{{1680}}"
    r"\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"
)


@query(
    f"""select page_id, clean, length(html) - length(clean) as dropped
        from (select page_id, html, {SANITIZE_SQL.format(c="html")} as clean from pages)"""
)
def sanitize_text(spark, sf_dir):
    clean = text.sanitize(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", "html", clean.alias("clean")).select(
        "page_id", "clean", (F.length("html") - F.length("clean")).alias("dropped")
    )


@query(
    f"select doc_id, cast({TOKENS_SQL} as bigint) as tokens, cast(len({WORDS_SQL}) as bigint) as words from documents"
)
def token_counts(spark, sf_dir):
    body = F.col("text")
    return spread_documents(spark, sf_dir).select(
        "doc_id", text.token_count(body).alias("tokens"), text.word_count(body).alias("words")
    )


@query(
    rf"""select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines, length(text) as characters,
         cast(len({WORDS_SQL}) as bigint) as words, md5(text) as hash,
         cast(len(regexp_extract_all(code, '(?m)^\s*class\s+[\p{{L}}\p{{N}}_]+')) as bigint) as classes,
         cast(len(regexp_extract_all(code, '(?m)^\s*def\s+[\p{{L}}\p{{N}}_]+')) as bigint) as functions
         from (select *, 'def f():' || chr(10) || replace(text, '. ', chr(10) || ' class ') as code from documents)"""
)
def text_stats(spark, sf_dir):
    """The driver's texts hold no code, so sentence ends are turned into class lines."""
    body = F.col("text")
    code = F.concat(F.lit("def f():\n"), F.replace(body, F.lit(". "), F.lit("\n class ")))
    return spread_documents(spark, sf_dir).select(
        "doc_id",
        text.line_count(body).alias("lines"),
        text.char_count(body).alias("characters"),
        text.word_count(body).alias("words"),
        text.content_hash(body).alias("hash"),
        text.definition_count(code, "class").alias("classes"),
        text.definition_count(code, "def").alias("functions"),
    )


TYPE_SQL = """case when ext = 'pdf' then 'pdf' when ext in ('doc', 'docx') then 'docx'
  when ext in ('xls', 'xlsx') then 'excel' when ext = 'py' then 'py'
  when ext in ('js', 'html', 'css', 'json', 'ts', 'jsx', 'tsx') then 'code' {zip} else 'txt' end"""


@query(
    f"""select doc_id, filename, {TYPE_SQL.format(zip="when ext = 'zip' then 'zip'")} as file_type,
               {TYPE_SQL.format(zip="")} as upload_type
        from (select doc_id, filename,
                     case when contains(filename, '.') then lower(string_split(filename, '.')[-1]) else '' end as ext
              from (select doc_id, {FILENAME_SQL} as filename from documents))"""
)
def file_types(spark, sf_dir):
    name = F.col("filename")
    return documents(spark, sf_dir).select("doc_id", filename_of().alias("filename")).select(
        "doc_id", "filename",
        text.file_type(name).alias("file_type"), text.file_type(name, archives=False).alias("upload_type"),
    )


@query(
    f"""select page_id, ext as extension, {TYPE_SQL.format(zip="when ext = 'zip' then 'zip'")} as file_type
        from (select page_id, case when contains(url, '.') then lower(string_split(url, '.')[-1]) else '' end as ext
              from pages)"""
)
def url_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.extension(F.col("url")).alias("extension"), text.file_type(F.col("url")).alias("file_type")
    )


@query(
    f"""select archive, rel_path, size, true as from_zip,
               case when suffix = '.pdf' then 'pdf' when suffix = '.DOCX' then 'docx' when suffix = '.py' then 'py'
                    when suffix = '.html' then 'code' else 'txt' end as file_type
        from (select source as archive, 'docs/' || {FILENAME_SQL} as rel_path, n_chars * 2000 as size,
                     {pick_sql((".pdf", ".DOCX", ".py", ".zip", ".html", ".txt", ".xls", ""), "doc_id")} as suffix
              from documents)
        where size <= 10485760 and suffix in ('.pdf', '.DOCX', '.py', '.html', '.txt')"""
)
def archive_routing(spark, sf_dir):
    manifest = documents(spark, sf_dir).select(
        F.col("source").alias("archive"),
        F.concat(F.lit("docs/"), filename_of()).alias("rel_path"),
        (F.col("n_chars") * 2000).alias("size"),
    )
    return archive_members(manifest)


@query(
    rf"""select doc_id, filename, file_type, text, length(text) - length(replace(text, chr(10), '')) + 1 as lines,
         length(text) as characters,
         case when file_type = 'txt' then cast(len({WORDS_SQL}) as bigint) end as words,
         case when file_type = 'py' then 0 end as classes,
         case when file_type = 'code' then ext end as extension
         from (select doc_id, text, {FILENAME_SQL} as filename,
                      ['py', 'html', 'txt', 'txt'][ext_no] as ext,
                      ['py', 'code', 'txt', 'txt'][ext_no] as file_type
               from (select *, case doc_id % 8 when 2 then 1 when 4 then 2 when 5 then 3 when 7 then 4 end as ext_no
                     from documents) where ext_no is not null)"""
)
def text_extraction(spark, sf_dir):
    files = documents(spark, sf_dir).select(
        "doc_id", filename_of().alias("filename"), F.col("text").cast("binary").alias("content"),
        F.length(F.col("text").cast("binary")).cast("bigint").alias("length"),
    )
    typed = files.withColumn("file_type", text.file_type(F.col("filename")))
    done = extract_text(typed.where(F.col("file_type").isin("txt", "py", "code")))
    return done.select(
        F.regexp_extract("filename", r"^f(\d+)", 1).cast("bigint").alias("doc_id"), "filename", "file_type", "text",
        "metadata.lines", "metadata.characters", "metadata.words",
        F.col("metadata.classes").cast("int").alias("classes"), "metadata.extension",
    )


@query("select url as filename, md5(html) as digest from pages")
def content_digests(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("path"), F.col("url").alias("filename"), F.col("html").cast("binary").alias("content")
    )
    return content_digest(files).drop("path")


@query("select md5(text) as hash, min(doc_id) as first_idx, count(*) as copies from documents group by 1")
def dedup_prompts(spark, sf_dir):
    return dedup.dedup_groups(prompts(spark, sf_dir))


@query(
    """select doc_id as idx, md5(text) as hash, text from documents
       qualify row_number() over (partition by md5(text) order by doc_id) = 1"""
)
def unique_prompts(spark, sf_dir):
    return dedup.unique_prompts(prompts(spark, sf_dir))


@query(
    """select doc_id as idx, md5(text) as hash, min(doc_id) over (partition by md5(text)) as first_idx
       from documents"""
)
def dedup_links(spark, sf_dir):
    return dedup.dedup_links(prompts(spark, sf_dir))


@query(
    """select hash, segment_no, string_agg(cast(doc_id as varchar), ',' order by doc_id) as indices
       from (select md5(text) as hash, doc_id,
                    (row_number() over (partition by md5(text) order by doc_id) - 1) // 100000 as segment_no
             from documents) group by 1, 2"""
)
def dedup_index_lists(spark, sf_dir):
    lists = dedup.index_lists(prompts(spark, sf_dir))
    return lists.select(
        "hash", "segment_no", F.array_join(F.col("items").cast("array<string>"), ",").alias("indices")
    )


@query(
    """with firsts as (select doc_id, min(doc_id) over (partition by md5(text)) as first_idx from documents)
       select cast(f.doc_id as varchar) as custom_id, l.quality, l.toxic
       from firsts f left join labels l on l.doc_id = f.first_idx"""
)
def expand_results(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("custom_id"), F.col("doc_id").alias("seq"), "quality", "toxic"
    )
    return dedup.in_id_order(dedup.expand_results(prompts(spark, sf_dir), results))


BATCH_SIZE_SQL = """case when {n} <= 5000 then {n} else coalesce(
  list_filter([5000, 4500, 4000, 3500, 3000, 2500, 2000, 1500], lambda s: {n} % s < 100)[1], 5000) end"""


@query(f"select o_orderkey, cast({BATCH_SIZE_SQL.format(n='(o_orderkey * 3)')} as bigint) as batch_size from orders")
def batch_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", requests.batch_size(F.col("o_orderkey") * 3).alias("batch_size")
    )


ITEM_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


@query(
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, idx // size as batch_no,
               cast(idx % size as varchar) as custom_id, (idx // size) * size as start_item,
               least((idx // size) * size + size, total) as end_item
        from (select *, row_number() over (order by {", ".join(ITEM_ORDER)}) - 1 as idx from lineitem),
             (select total, cast({BATCH_SIZE_SQL.format(n="total")} as bigint) as size
              from (select count(*) as total from lineitem))"""
)
def assign_batches(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*ITEM_ORDER)
    return requests.assign_batches_in_order(items, ITEM_ORDER).select(
        *ITEM_ORDER[:4], "batch_no", "custom_id", "start_item", "end_item"
    )


@query(
    f"""select doc_id, doc_id // size as batch_no, cast(doc_id % size as varchar) as custom_id,
               (doc_id // size) * size as start_item, least((doc_id // size) * size + size, total) as end_item
        from documents, (select total, cast({BATCH_SIZE_SQL.format(n="total")} as bigint) as size
                         from (select count(*) as total from documents))"""
)
def assign_batches_by_key(spark, sf_dir):
    """Document ids are dense already: no shuffle at all."""
    return requests.assign_batches(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query(
    f"""select doc_id, cast(doc_id as varchar) as custom_id, 'POST' as method, '/v1/chat/completions' as url,
               model, 'user' as role, {SANITIZE_SQL.format(c="text")} as content, 1024 as max_tokens,
               0.7::double as temperature,
               case when contains(lower(model), 'o1') then 'medium' end as reasoning_effort,
               'json_object' as response_format
        from (select doc_id, text, {MODEL_SQL} as model from documents)"""
)
def build_requests(spark, sf_dir):
    rows = spread_documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("custom_id"), "text")
    built = requests.build_requests(rows, model_of())
    return built.select(
        "doc_id", "custom_id", "method", "url", "body.model",
        F.col("body.messages")[0]["role"].alias("role"), F.col("body.messages")[0]["content"].alias("content"),
        "body.max_tokens", "body.temperature", "body.reasoning_effort",
        F.col("body.response_format.type").alias("response_format"),
    )


@query(
    f"""select idx as doc_id, pos // size as batch_no, cast(idx as varchar) as custom_id, (pos // size) * size as start_item,
               least((pos // size) * size + size, total) as end_item, clean as content, 'medium' as reasoning_effort
        from (select *, row_number() over (order by idx) - 1 as pos,
                     cast({BATCH_SIZE_SQL.format(n="total")} as bigint) as size
              from (select *, count(*) over () as total
                    from (select doc_id as idx, {SANITIZE_SQL.format(c="text")} as clean from documents
                          qualify row_number() over (partition by md5(clean) order by doc_id) = 1)))"""
)
def submit_batches(spark, sf_dir):
    """From prompts to request records: clean, drop copies, cut into batches, shape."""
    cleaned = spread_documents(spark, sf_dir).select(
        F.col("doc_id").alias("idx"), text.sanitize(F.col("text")).alias("text")
    )
    unique, indices = dedup.unique_with_indices(cleaned)
    batched = requests.assign_batches_in_order(unique.drop("hash"), ["idx"], ids=F.col("idx"), unique=True, keys=indices)
    return requests.build_requests(batched, "o1-mini").select(
        F.col("idx").alias("doc_id"), "batch_no", "custom_id", "start_item", "end_item",
        F.col("body.messages")[0]["content"].alias("content"), "body.reasoning_effort",
    )


def _usage(spark, sf_dir):
    return spread_documents(spark, sf_dir).select(
        model_of().alias("model"),
        text.token_count(F.col("text")).alias("input_tokens"),
        F.floor(F.col("n_chars") / 4).cast("bigint").alias("output_tokens"),
        (F.col("doc_id") % 100).alias("reasoning_tokens"),
    )


@query(
    f"""select *, case when input_price = 75 then 'o1-pro' when input_price = 8 then 'o1-mini'
                  when input_price = 3 then 'gpt-4o' when input_price = 15 then 'gpt-4'
                  when input_price = 0.5 then 'gpt-3.5-turbo' else 'default' end as price_key
        from (select model, requests, {PRICED_SQL.format(m="model")}
              from (select {MODEL_SQL} as model, count(*) as requests from documents group by 1))"""
)
def price_lookup(spark, sf_dir):
    asked = documents(spark, sf_dir).groupBy(model_of().alias("model")).agg(F.count(F.lit(1)).alias("requests"))
    model = F.lower("model")
    return asked.select(
        "model", "requests", pricing.price_key(model).alias("price_key"),
        *[pricing.price_of(model, k).cast("double").alias(f"{k}_price") for k in ("input", "output", "reasoning")],
    )


def cost_sql(model: str, output: str, reasoning: str) -> str:
    return f"""
select model, cast(grouping(model) as int) as is_total, cast(sum(requests) as bigint) as requests,
       cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens,
       cast(sum(r) as bigint) as reasoning_tokens,
       cast(sum(i * input_price) as double) / 1e6 as input_cost,
       cast(sum(o * output_price) as double) / 1e6 as output_cost,
       cast(sum(r * reasoning_price) as double) / 1e6 as reasoning_cost,
       cast(sum(i * input_price + o * output_price + r * reasoning_price) as double) / 1e6 as total_cost
from (select *, {PRICED_SQL.format(m="model")}
      from (select lower({model}) as model, count(*) as requests, sum({TOKENS_SQL}) as i, sum({output}) as o,
                   sum({reasoning}) as r
            from documents group by 1))
group by rollup(model)"""


@query(cost_sql(model=MODEL_SQL, output="n_chars // 4", reasoning="doc_id % 100"))
def cost_by_model(spark, sf_dir):
    return requests.cost_by_model(_usage(spark, sf_dir))


@query(
    f"""select requests as prompts, input_tokens as total_input_tokens, output_tokens as total_output_tokens,
               input_cost, output_cost, reasoning_cost, total_cost, 10.0::double as budget,
               total_cost <= 10.0 as within_budget
        from ({cost_sql(model="'gpt-4o-mini'", output="1024", reasoning="0")}) where is_total = 1"""
)
def estimate_batch_cost(spark, sf_dir):
    return requests.estimate_batch_cost(spread_documents(spark, sf_dir).select("text"), "gpt-4o-mini", 1024, budget=10.0)


RUN_COST_SQL = f"""
select conv_id, turn, model,
       cast(len({WORDS_SQL}) as bigint) as prompt_tokens, length(text) // 4 as completion_tokens,
       cast(case when contains(model, 'gpt-4') then 30 when contains(model, 'gpt-3.5-turbo') then 0.5 else 0 end
            as decimal(12, 4)) * len({WORDS_SQL})
       + cast(case when contains(model, 'gpt-4') then 60 when contains(model, 'gpt-3.5-turbo') then 1.5 else 0 end
              as decimal(12, 4)) * (length(text) // 4) as cost
from (select *, {pick_sql(MODELS, "conv_id")} as model from conversations)"""


@query(
    f"""select conv_id, turn, model, prompt_tokens, completion_tokens, cast(cost as double) / 1e6 as cost,
               cast(spent as double) / 1e6 as spent_before, spent < 5000 as admitted
        from (select *, coalesce(sum(cost) over (partition by conv_id order by turn
                                 rows between unbounded preceding and 1 preceding), 0) as spent
              from ({RUN_COST_SQL}))"""
)
def request_cost_running(spark, sf_dir):
    """Half a cent per conversation; costs are kept in exact millionths of a dollar."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", model_of("conv_id").alias("model"),
        text.word_count(F.col("text")).alias("prompt_tokens"),
        F.floor(F.length("text") / 4).cast("bigint").alias("completion_tokens"),
    )
    cost = pricing.run_cost_millionths(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    ran = limits.budget_cutoff(rows.withColumn("cost", cost), ["conv_id"], ["turn"], "cost", 5000, block_of("turn"))
    return ran.select(
        "conv_id", "turn", "model", "prompt_tokens", "completion_tokens",
        pricing.dollars(F.col("cost")).alias("cost"), pricing.dollars(F.col("spent_before")).alias("spent_before"),
        "admitted",
    )


def _event_requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", (F.col("event_id") * 7919 % 30000 + 1).alias("tokens")
    )


@query(
    """select date_trunc('minute', ts) as minute, cast(sum(event_id * 7919 % 30000 + 1) as bigint) as tokens,
              count(*) as requests, sum(event_id * 7919 % 30000 + 1) > 60000 or count(*) > 3000 as over_limit
       from events group by 1"""
)
def rate_usage(spark, sf_dir):
    return limits.rate_usage(_event_requests(spark, sf_dir))


CODES = ("200", "429", "500", "400", "503")
MESSAGES = (
    "Error code: 401 - bad key", "HTTP 429 Too Many Requests", "400: unknown MODEL", "400 bad payload",
    "Batch Not Found", "socket closed", "Invalid API key given", "404",
)


@query(
    f"""select event_id, message,
          case when contains(m, '401') or contains(m, 'authentication') or contains(m, 'api key') then 'authentication'
               when contains(m, '429') then 'rate_limit'
               when contains(m, '400') and contains(m, 'model') then 'invalid_model'
               when contains(m, '400') then 'bad_request'
               when contains(m, '404') or contains(m, 'not found') then 'not_found' else 'other' end as error_class
        from (select *, lower(message) as m
              from (select event_id, {pick_sql(MESSAGES, "event_id")} || ' [' || event_type || ']' as message
                    from events))"""
)
def classify_errors(spark, sf_dir):
    message = F.concat(pick(MESSAGES, F.col("event_id")), F.lit(" ["), F.col("event_type"), F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message")).select(
        "event_id", "message", classify_error(F.col("message")).alias("error_class")
    )


ATTEMPTS_SQL = f"""
select event_id, user_id, status_code, attempt,
       status_code in (429, 500, 502, 503, 504) and attempt < 3 as will_retry,
       case when status_code in (429, 500, 502, 503, 504) and attempt < 3 then pow(2.0, attempt) end as delay
from (select event_id, user_id, cast({pick_sql(CODES, "event_id")} as int) as status_code,
             row_number() over (partition by user_id order by event_id) - 1 as attempt from events)"""


def _attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", pick(CODES, F.col("event_id")).cast("int").alias("status_code")
    )
    tried = position_in_group(events, ["user_id"], ["event_id"], block_of("event_id"), "attempt")
    again = retryable(F.col("status_code"), F.col("attempt"))
    return tried.withColumn("will_retry", again).withColumn(
        "delay", F.when(F.col("will_retry"), retry_delay(F.col("attempt")))
    )


@query(ATTEMPTS_SQL)
def retry_attempts(spark, sf_dir):
    return _attempts(spark, sf_dir)


@query(
    f"""select user_id, count(*) as attempts, coalesce(sum(delay), 0) as waited,
               max_by(status_code, attempt) as final_status, max_by(status_code, attempt) = 200 as success
        from ({ATTEMPTS_SQL}) group by user_id"""
)
def retry_outcomes(spark, sf_dir):
    return (
        _attempts(spark, sf_dir)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("delay"), F.lit(0.0)).alias("waited"),
            F.max_by("status_code", "attempt").alias("final_status"),
        )
        .withColumn("success", F.col("final_status") == 200)
    )


@query(
    f"""with asked as (select {MODEL_SQL} as model, count(*) as requests from documents group by 1),
             offered as (select {pick_sql(MODELS[:4], "conv_id")} as model from conversations group by 1)
        select a.model, a.requests, coalesce(o.model, 'gpt-3.5-turbo') as resolved
        from asked a left join offered o on o.model = a.model
          and regexp_matches(o.model, '(?i)o1|gpt|text-embedding')"""
)
def resolve_models(spark, sf_dir):
    """Asked for by documents, offered by what conversations used."""
    offered = table(spark, sf_dir, "conversations").select(pick(MODELS[:4], F.col("conv_id")).alias("model"))
    asked = documents(spark, sf_dir).select(model_of().alias("model"))
    return requests.resolve_models(asked, requests.compatible_models(offered))
