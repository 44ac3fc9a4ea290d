"""Round trips through files: driver tables are written by the sinks and read back by the sources."""

from pyspark.sql import functions as F

from inkwell.functions.evaluation import add_rule, scored
from inkwell.operators import tracking
from inkwell.operators.groups import SEGMENT_CHARS
from inkwell.plans.registry import FILENAME_SQL, documents, filename_of, pick, pick_sql, query, source_number, table
from inkwell.session import fresh_folder
from inkwell.sources import files, sinks
from inkwell.sources.readers import Readers, process_listed

LINE_SCHEMA = "custom_id string, status string, model string, choices array<struct<message struct<role string, content string>>>"

#: So many characters go to a prompt file and the task that writes it, at four files or more.
FILE_CHARS = 64 * 1024**2


@query(
    """select cast(row_number() over (order by doc_id, n) - 1 as bigint) as prompt_idx, line as text
       from (select doc_id, generate_subscripts(lines, 1) as n, trim(unnest(lines), ' ' || chr(9)) as line
             from (select doc_id, string_split(text, chr(10)) as lines from documents)) where line <> ''"""
)
def prompt_files(spark, sf_dir):
    """Whole texts as prompt files in order, of about ``FILE_CHARS`` each; every line that is not blank is a prompt."""
    folder = fresh_folder(spark, "prompts")
    texts = documents(spark, sf_dir).select("doc_id", "text")
    chars = texts.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    ordered = texts.repartitionByRange(max(4, -(-chars // FILE_CHARS)), "doc_id").sortWithinPartitions("doc_id")
    ordered.select("text").write.text(folder)
    return files.prompt_lines(spark, folder).select("prompt_idx", "text")


def answer_lines(spark, sf_dir):
    """Turns as result lines of their conversation; NULL fields stay out of the file."""
    turns = table(spark, sf_dir, "conversations")
    message = F.struct("role", F.col("text").alias("content"))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"),
        F.when(F.col("turn") % 2 == 0, "completed").alias("status"),
        F.lit(None).cast("string").alias("model"),
        F.array(F.struct(message.alias("message"))).alias("choices"),
        F.concat(F.lit("b"), (F.col("conv_id") % 7).cast("string")).alias("batch_id"),
    )


@query(
    """select conv_id || '-' || turn as custom_id, case when turn % 2 = 0 then 'completed' end as status,
              null::varchar as model, role, text as content from conversations"""
)
def jsonl_round_trip(spark, sf_dir):
    folder = fresh_folder(spark, "jsonl")
    sinks.write_jsonl(answer_lines(spark, sf_dir).drop("batch_id"), folder)
    schema = spark.createDataFrame([], LINE_SCHEMA).schema
    message = F.col("choices")[0]["message"]
    return files.read_jsonl(spark, folder, schema).select(
        "custom_id", "status", "model", message["role"].alias("role"), message["content"].alias("content")
    )


@query(
    """select 'b' || (conv_id % 7) as batch_id, count(*) as lines, cast(sum(length(text)) as bigint) as characters
       from conversations where conv_id % 7 <> 3 or turn < 2 group by 1"""
)
def stored_results(spark, sf_dir):
    """All batches are stored; one is stored again with fewer lines, which replaces it alone."""
    folder = fresh_folder(spark, "results")
    lines = answer_lines(spark, sf_dir)
    sinks.write_results(lines, folder)
    turn = F.substring_index("custom_id", "-", -1).cast("int")
    sinks.write_results(lines.where((F.col("batch_id") == "b3") & (turn < 2)), folder)
    return files.read_results(spark, folder).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length(F.col("choices")[0]["message"]["content"])).alias("characters")
    )


@query("select conv_id, turn, role, text from conversations")
def csv_export(spark, sf_dir):
    """Texts with quotes, commas and line ends come back as they were."""
    folder = fresh_folder(spark, "csv")
    sinks.export_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), folder)
    reader = spark.read.schema("conv_id bigint, turn int, role string, text string")
    return reader.option("header", "true").option("escape", '"').option("multiLine", "true").csv(folder)


@query("select page_id, case when page_id % 3 > 0 then url end as url, html from pages")
def json_export(spark, sf_dir):
    folder = fresh_folder(spark, "json")
    pages = table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 3 > 0, F.col("url")))
    sinks.export_json(pages.select("page_id", "url", "html"), folder)
    return spark.read.schema("page_id bigint, url string, html string").json(folder)


@query(
    """select prompt, count(*) as answers, max(custom_id) as custom_id, max(content) as content from (
           select role || conv_id as prompt, conv_id || '-' || turn as custom_id, text as content from conversations
           union all select role || conv_id, conv_id || '-' || turn, text from conversations where turn = 0) group by 1"""
)
def appended_store(spark, sf_dir):
    folder = fresh_folder(spark, "store")
    kept = table(spark, sf_dir, "conversations").select(
        F.concat("role", F.col("conv_id").cast("string")).alias("prompt"),
        F.struct(F.concat_ws("-", "conv_id", "turn").alias("custom_id"), F.col("text").alias("content")).alias("response"),
        "turn",
    )
    sinks.append_store(kept, folder)
    sinks.append_store(kept.where("turn = 0"), folder)
    return files.read_store(spark, folder).groupBy("prompt").agg(
        F.count(F.lit(1)).alias("answers"),
        F.max("response.custom_id").alias("custom_id"),
        F.max("response.content").alias("content"),
    )


@query(
    """select doc_id, len(string_split(text, chr(10))) <= 3 as passed, cast(len(string_split(text, chr(10))) as double) as score,
              'lines=' || len(string_split(text, chr(10))) as details from documents"""
)
def own_rule(spark, sf_dir):
    """A rule of the caller beside the named ones."""

    def few_lines(response, criteria):
        n = F.size(F.split(response, "\n"))
        return F.struct((n <= criteria["most"]).alias("passed"), n.cast("double").alias("score"), F.concat(F.lit("lines="), n).alias("details"))

    verdict = scored(few_lines, F.col("text"), {"most": 3})
    return documents(spark, sf_dir).select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query(
    """select doc_id, passed, cast(score as double) as score, case when passed then 'few' else 'many' end as details from (
           select doc_id, len(regexp_extract_all(text, '\\S+')) as score, len(regexp_extract_all(text, '\\S+')) <= 50 as passed from documents)"""
)
def named_rule(spark, sf_dir):
    """A rule of the caller made known under a name."""

    def few_words(response, criteria):
        n = F.size(F.regexp_extract_all(response, F.lit(r"\S+"), F.lit(0)))
        few = n <= criteria["most"]
        return F.struct(few.alias("passed"), n.cast("double").alias("score"), F.when(few, "few").otherwise("many").alias("details"))

    add_rule("few_words", few_words)
    verdict = scored("few_words", F.col("text"), {"most": 50})
    return documents(spark, sf_dir).select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


# -- mixed files ---------------------------------------------------------------

#: Bytes above which a line of an archive is too large a member.
MEMBER_LIMIT = 200
MEMBER_SUFFIXES = (".md", ".exe", ".py", "")

FILES_SQL = f"""
files as (
  select doc_id, {FILENAME_SQL} as filename, text,
         case doc_id % 8 when 0 then 'pdf' when 1 then 'docx' when 2 then 'py' when 3 then 'zip' when 4 then 'code' when 6 then 'excel'
              else 'txt' end as kind
  from documents
)"""
READ_SQL = """
select filename, case when kind in ('docx', 'excel') then 'Error processing file: no reader registered for ' || kind else text end as text,
       case when kind in ('docx', 'excel') then 'error' when kind = 'zip' then 'txt' else kind end as file_type from files"""


def mixed_files(spark, sf_dir):
    """Texts as files of all types by name."""
    content = F.col("text").cast("binary")
    return documents(spark, sf_dir).select(
        filename_of().alias("filename"), F.length(content).cast("bigint").alias("length"), content.alias("content")
    )


def mixed_readers():
    """Stand-ins for decoders: a pdf is its text, the lines of an archive are its members."""
    readers = Readers()
    body = F.col("content").cast("string")

    def pdf(found):
        metadata = files.metadata_struct(filename=F.col("filename"), file_size=F.col("length"), pages=F.lit(1))
        return found.select("filename", body.alias("text"), "file_type", metadata.alias("metadata"))

    def archive(found):
        lines = found.select("filename", F.posexplode(F.split(body, "\n", -1)).alias("n", "line"))
        content = F.col("line").cast("binary")
        return lines.select(
            F.concat(F.col("filename"), F.lit("/m"), F.col("n"), pick(MEMBER_SUFFIXES, F.col("n"))).alias("rel_path"),
            F.when(F.col("n") % 5 > 0, F.length(content).cast("bigint")).alias("size"), content.alias("content"),
        )

    readers.register("pdf", pdf)
    readers.register("zip", archive)
    return readers


@query(f"with {FILES_SQL} {READ_SQL}")
def process_files_separate(spark, sf_dir):
    return process_listed(mixed_files(spark, sf_dir), readers=mixed_readers()).select("filename", "text", "file_type")


@query(
    f"""with {FILES_SQL}, members as (
           select filename || '/m' || n || {pick_sql(MEMBER_SUFFIXES, "n")} as filename, line, n,
                  case when n % 5 > 0 then strlen(line) end as size
           from (select filename, unnest(string_split(text, chr(10))) as line,
                        cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as n from files where kind = 'zip')
       ), judged as (
           select *, case when n % 4 in (1, 3) then 'not text by name' when size is null then 'size unknown'
                          when size > {MEMBER_LIMIT} then 'too large' end as skipped from members
       )
       select *, false as from_zip, null::varchar as skipped from ({READ_SQL} where kind <> 'zip')
       union all
       select filename, coalesce('Skipped: ' || skipped, line), case when skipped is not null then 'skipped' when n % 4 = 2 then 'py' else 'txt' end,
              true, skipped from judged"""
)
def process_files_zip(spark, sf_dir):
    """Every member has a row: its text, or why it is skipped."""
    done = process_listed(mixed_files(spark, sf_dir), "zip", mixed_readers(), MEMBER_LIMIT, with_skipped=True)
    skipped = F.when(F.col("file_type") == "skipped", F.col("metadata.error"))
    return done.select("filename", "text", "file_type", "from_zip", skipped.alias("skipped"))


@query(
    f"""with {FILES_SQL}, pieces as (
           select filename, chr(10) || chr(10) || '==== FILE: ' || filename || ' ====' || chr(10) || chr(10) || text as piece from ({READ_SQL})
       ), placed as (
           select *, cast(coalesce(sum(length(piece)) over (order by filename rows between unbounded preceding and 1 preceding), 0)
                          // {SEGMENT_CHARS} as bigint) as segment_no from pieces
       )
       select segment_no, count(*) as files, string_agg(piece, '' order by filename) as text from placed group by 1"""
)
def process_files_combine(spark, sf_dir):
    return process_listed(mixed_files(spark, sf_dir), "combine", mixed_readers())


@query(
    """select 'batch_' || case when o_orderkey % 2 = 0 then cast(1704067200 + o_orderkey as varchar) || '_' else 'x' end || o_orderkey as id,
              'detected' as status,
              strftime(case when o_orderkey % 2 = 0 then make_timestamp((1704067200 + o_orderkey) * 1000000) else o_orderdate end,
                       '%Y-%m-%dT%H:%M:%S') as created_at,
              '/in/' || o_orderkey as input_file, cast(o_orderkey % 1000 as varchar) as file_size
       from orders where o_orderkey % 3 > 0"""
)
def detected_rows(spark, sf_dir):
    """Orders as input files: an epoch in the name counts before the file's own time; each third is tracked already."""
    key = F.col("o_orderkey")
    stamp = F.when(key % 2 == 0, F.concat((key + 1704067200).cast("string"), F.lit("_"))).otherwise("x")
    listed = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("batch_"), stamp, key.cast("string")).alias("id"), F.concat(F.lit("/in/"), key.cast("string")).alias("path"),
        (key % 1000).alias("length"), F.col("o_orderdate").cast("timestamp").alias("modified"), key,
    )
    found = tracking.detected_batches(listed.drop("o_orderkey"), listed.where(key % 3 == 0), F.current_timestamp())
    return found.select("id", "status", "created_at", F.col("metadata.input_file").alias("input_file"), F.col("metadata.file_size").alias("file_size"))


@query(
    """select source, batch, case when n % 4 > 0 then 'completed' else 'unknown' end as status, '2024-01-01T00:00:00' as last_updated,
              request_count, request_count as results, ids
       from (select source, doc_id // 5000 as batch, cast(regexp_extract(source, '(\\d+)$', 1) as int) as n, count(*) as request_count,
                    cast(sum(doc_id) as bigint) as ids from documents group by 1, 2, 3)"""
)
def batch_records(spark, sf_dir):
    """A record file per batch of at most 5,000 documents of a source; what a record leaves out takes its default."""
    folder = fresh_folder(spark, "records")
    n, batch = source_number(), F.floor(F.col("doc_id") / 5000).cast("string").alias("batch")
    records = documents(spark, sf_dir).groupBy("source", batch).agg(
        F.count(F.lit(1)).alias("request_count"), F.collect_list(F.struct(F.col("doc_id").cast("string").alias("custom_id"))).alias("results")
    ).select(
        F.when(n % 4 > 0, "completed").alias("status"), F.lit("2024-01-01T00:00:00").alias("created_at"), "request_count",
        F.create_map(F.lit("source"), F.col("source"), F.lit("batch"), F.col("batch")).alias("metadata"), "results",
    )
    records.write.option("maxRecordsPerFile", 1).json(folder)
    read = files.read_batch_records(spark, folder)
    ids = files.child_rows(read, "results").groupBy("batch_id").agg(F.sum(F.col("custom_id").cast("bigint")).alias("ids"))
    facts = read.select(
        F.col("id").alias("batch_id"), F.col("metadata")["source"].alias("source"), F.col("metadata")["batch"].cast("bigint").alias("batch"),
        "status", "last_updated", "request_count", F.size("results").cast("bigint").alias("results"),
    )
    return facts.join(ids, "batch_id").drop("batch_id")


@query(
    """select doc_id, md5(s || '|' || u || '|' || text) as digest
       from documents, (select string_agg(text || chr(10), '' order by item_id) as s from benchmark),
            (select string_agg(n_name || chr(10), '' order by n_name) as u from nation)"""
)
def prompted_documents(spark, sf_dir):
    """Default prompts from their files, put ahead of every document."""
    system, user = fresh_folder(spark, "system"), fresh_folder(spark, "user")
    table(spark, sf_dir, "benchmark").coalesce(1).sortWithinPartitions("item_id").select("text").write.text(system)
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_name").select("n_name").write.text(user)
    prompts = files.default_prompts(spark, system, user)
    asked = documents(spark, sf_dir).select("doc_id", "text").crossJoin(F.broadcast(prompts))  # one row
    return asked.select("doc_id", F.md5(F.concat_ws("|", "system", "user", "text")).alias("digest"))
