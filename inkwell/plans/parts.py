"""Chunking, merging and assembling documents."""

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import chunking, completion, results
from inkwell.operators import documents as docs
from inkwell.operators.groups import block_of
from inkwell.plans.registry import (
    FILENAME_SQL,
    SEGMENT_SQL,
    WORDS_SQL,
    documents,
    filename_of,
    query,
    spread_documents,
    table,
)
from inkwell.sources.files import metadata_struct

WORD_CHUNKS_SQL = f"""
select doc_id, i as chunk_index, len(chunks) as n_chunks, chunks[i + 1] as content
from (select doc_id, chunks, unnest(range(len(chunks))) as i
      from (select doc_id, case when len(w) <= 200 then [text] else
              list_transform(range(0, len(w), 180), lambda s: array_to_string(w[s + 1:s + 200], ' ')) end as chunks
            from (select doc_id, text, {WORDS_SQL} as w from documents)))"""


@query(WORD_CHUNKS_SQL)
def chunk_words(spark, sf_dir):
    return chunking.chunk_words(spread_documents(spark, sf_dir).select("doc_id", "text"), 200, 20)


# The fold over units, with elements and accumulator of one struct type. RE2 has no
# look-behind: sentence ends are marked first. These texts hold no blank lines, so
# the paragraph unit is the whole text and never fits.
CHAR_CHUNKS_SQL = """
with sentences as (
  select *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss
  from {source} where length(text) > 4000
),
units as (
  select {keys}, flatten(list_transform(ss, lambda s: case when length(s) <= 4000
      then [{{'k': 'S', 'v': s, 'c': []::varchar[], 'u': ''}}]
      else list_concat([{{'k': 'B', 'v': '', 'c': []::varchar[], 'u': ''}}],
        list_transform(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''),
          lambda w: {{'k': 'W', 'v': w, 'c': []::varchar[], 'u': ''}})) end)) as us
  from sentences
),
folded as (
  select {keys}, list_reduce(us, lambda a, x: {{
      'k': '', 'v': '',
      'c': case when x.k = 'B' then case when a.u <> '' then list_append(a.c, a.u) else a.c end
                when length(a.u) + length(x.v) <= 4000 then a.c
                when a.u <> '' or x.k = 'W' then list_append(a.c, a.u) else a.c end,
      'u': case when x.k = 'B' then '' when length(a.u) + length(x.v) <= 4000 then a.u || x.v || ' '
                else x.v || ' ' end}},
    {{'k': '', 'v': '', 'c': []::varchar[], 'u': ''}}) as f
  from units
),
packed as (
  select {keys}, case when f.u <> '' then list_append(f.c, f.u) else f.c end as ch from folded
),
chunked as (
  select {keys}, list_transform(ch, lambda x, i: case when i = 1 then x else right(ch[i - 1], 200) || x end) as chunks
  from packed
  union all select {keys}, [text] from {source} where length(text) <= 4000
)
select {keys}, i as chunk_index, len(chunks) as n_chunks, chunks[i + 1] as content
from (select {keys}, chunks, unnest(range(len(chunks))) as i from chunked)"""


@query(CHAR_CHUNKS_SQL.format(source="documents", keys="doc_id"))
def chunk_chars(spark, sf_dir):
    return chunking.chunk_chars(spread_documents(spark, sf_dir).select("doc_id", "text"))


@query(
    f"""select filename, chunk_index, n_chunks,
               case when n_chunks > 1 then '[' || filename || ' - Part ' || (chunk_index + 1) || '/' || n_chunks || '] '
                    else '[' || filename || '] ' end || content as prompt
        from ({CHAR_CHUNKS_SQL.format(
            source=f"(select {FILENAME_SQL} as filename, text from documents)", keys="filename")})"""
)
def label_prompts(spark, sf_dir):
    files = spread_documents(spark, sf_dir).select(filename_of().alias("filename"), "text")
    return chunking.label_prompts(files)


@query(
    r"""select doc_id, i as prompt_no, parts[i + 1] as prompt
        from (select doc_id, parts, unnest(range(len(parts))) as i
              from (select doc_id, list_filter(list_transform(
                        string_split(replace(text, '. ', chr(10) || '---' || chr(10)), '---'),
                        lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as parts
                    from documents))"""
)
def prompt_split(spark, sf_dir):
    marked = F.replace(F.col("text"), F.lit(". "), F.lit("\n---\n"))
    return chunking.split_prompts(spread_documents(spark, sf_dir).select("doc_id", marked.alias("text")))


@query(
    """select doc_id, case when length(text) > 5000 then left(text, 5000) || '... (truncated)' else text end as preview
       from documents"""
)
def preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(
    f"""select conv_id, segment_no, count(*) as pieces, string_agg(text, chr(10) order by turn) as text
        from (select *, {SEGMENT_SQL.format(size="length(text) + 1", keys="conv_id", order="turn")} as segment_no
              from conversations) group by 1, 2"""
)
def merge_chunks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return docs.merge_chunks(turns, ["conv_id"], ["turn"], F.col("text"), block_of("turn"))


@query(
    """select conv_id, (pos - 1) // 100000 as segment_no, string_agg(role || ':' || length(text), '|' order by turn) as log
       from (select *, row_number() over (partition by conv_id order by turn) as pos from conversations)
       group by 1, 2"""
)
def conversation_log(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    entry = F.struct("role", F.length("text").alias("size"))
    logged = docs.conversation_log(turns, ["conv_id"], ["turn"], entry, block_of("turn"))
    shown = F.transform("items", lambda e: F.concat(e["role"], F.lit(":"), e["size"].cast("string")))
    return logged.select("conv_id", "segment_no", F.array_join(shown, "|").alias("log"))


@query(
    """select p.conv_id as batch_id, cast(p.turn as varchar) as custom_id, p.text as prompt, r.text as response
       from conversations p join conversations r on r.conv_id = p.conv_id and r.turn = p.turn + 1
       where p.role = 'user' and r.role = 'assistant'"""
)
def pair_responses(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        F.col("conv_id").alias("batch_id"), F.col("turn").cast("string").alias("custom_id"),
        F.col("text").alias("prompt"),
    )
    answered = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("batch_id"), (F.col("turn") - 1).cast("string").alias("custom_id"),
        F.col("text").alias("response"),
    )
    return results.pair_responses(asked, answered)


HEADED_SQL = f"chr(10) || chr(10) || '==== FILE: ' || {FILENAME_SQL} || ' ====' || chr(10) || chr(10) || text"


@query(
    f"""select source, segment_no, count(*) as files, string_agg(piece, '' order by doc_id) as text
        from (select *, {SEGMENT_SQL.format(size="length(piece)", keys="source", order="doc_id")} as segment_no
              from (select source, doc_id, {HEADED_SQL} as piece from documents)) group by 1, 2"""
)
def combine_files(spark, sf_dir):
    files = documents(spark, sf_dir).select("source", "doc_id", filename_of().alias("filename"), "text")
    return docs.combine_files(files, ["source"], ["doc_id"], block_of("doc_id"))


@query(
    f"""select source, segment_no, string_agg(filename, ',' order by doc_id) as files, any_value(total) as total_files
        from (select source, doc_id, {FILENAME_SQL} as filename, count(*) over (partition by source) as total,
                     (row_number() over (partition by source order by doc_id) - 1) // 100000 as segment_no
              from documents) group by 1, 2"""
)
def combined_file_lists(spark, sf_dir):
    files = documents(spark, sf_dir).select(
        "source", "doc_id", filename_of().alias("filename"), text.file_type(filename_of()).alias("file_type")
    )
    listed = docs.combined_metadata(files, ["source"], ["doc_id"], block_of("doc_id"))
    return listed.select("source", "segment_no", F.array_join("files", ",").alias("files"), "total_files")


PAGE_SQL = """text || chr(10) || chr(10) || case when role = 'assistant' then
  chr(10) || 'Table ' || (turn + 1) || '-1:' || chr(10) || 'assistant | ' || chr(10) || left(text, 10) || ' | x' || chr(10) || chr(10)
  else '' end"""


@query(
    f"""select conv_id as doc_id, segment_no, string_agg(piece, '' order by turn) as text,
               any_value(pages) as pages, any_value(tables) as tables, any_value(has_images) as has_images
        from (select *, {SEGMENT_SQL.format(size="length(piece)", keys="conv_id", order="turn")} as segment_no,
                     count(*) over (partition by conv_id) as pages,
                     count(*) filter (role = 'assistant') over (partition by conv_id) as tables,
                     coalesce(bool_or(role = 'system') over (partition by conv_id), false) as has_images
              from (select conv_id, turn, role, {PAGE_SQL} as piece from conversations)) group by 1, 2"""
)
def pages_to_documents(spark, sf_dir):
    """Turns as pages; an answer also carries a table with an empty cell."""
    cells = F.array(
        F.array(F.col("role"), F.lit(None).cast("string")), F.array(F.substring("text", 1, 10), F.lit("x"))
    )
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text",
        F.when(F.col("role") == "assistant", F.array(cells)).alias("tables"),
        (F.col("role") == "system").alias("has_images"),
    )
    return docs.document_from_pages(pages, extract_tables=True)


BLOCKS_SQL = f"""
with pieces as (
  select conv_id, 0 as part, turn, text || chr(10) as piece from conversations where role = 'user'
  union all
  select conv_id, 1, turn, chr(10) || 'Table ' || row_number() over (partition by conv_id order by turn) || ':' || chr(10)
         || 'assistant | ' || left(text, 12) || chr(10) || chr(10)
  from conversations where role = 'assistant'
),
placed as (
  select *, {SEGMENT_SQL.format(size="length(piece)", keys="conv_id", order="part, turn")} as segment_no from pieces
),
texts as (select conv_id, segment_no, string_agg(piece, '' order by part, turn) as text from placed group by 1, 2),
facts as (
  select conv_id, count(*) filter (role = 'user') as paragraphs, count(*) filter (role = 'assistant') as tables,
         bool_or(role = 'system') as has_images
  from conversations group by 1
)
select conv_id as doc_id, coalesce(segment_no, 0) as segment_no, coalesce(text, '') as text, paragraphs, tables, has_images
from facts left join texts using (conv_id)"""


@query(BLOCKS_SQL)
def blocks_to_documents(spark, sf_dir):
    """Questions as paragraphs, answers as tables, system turns as images."""
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "table").otherwise("image")
    blocks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), kind.alias("kind"), F.col("turn").cast("int").alias("seq"), "text",
        F.array(F.array(F.col("role"), F.substring("text", 1, 12))).alias("cells"),
    )
    return docs.document_from_blocks(blocks)


@query(
    f"""select c_nationkey, segment_no,
               case when segment_no = 0 then 'c_custkey,c_name,c_mktsegment' || chr(10) else '' end
                 || string_agg(line, '' order by c_custkey) as text,
               any_value(n) as rows, 3::bigint as columns
        from (select *, {SEGMENT_SQL.format(size="length(line)", keys="c_nationkey", order="c_custkey")} as segment_no
              from (select c_nationkey, c_custkey, count(*) over (partition by c_nationkey) as n,
                           c_custkey || ',"' || c_name || ', ""' || c_mktsegment || '""' || '",' || c_mktsegment || chr(10) as line
                    from customer)) group by 1, 2"""
)
def table_to_csv(spark, sf_dir):
    """Customers per nation as sheets; names get a comma and quotes so that quoting shows."""
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    rows = table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", name.alias("c_name"), "c_mktsegment"
    )
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    return docs.table_text(rows, ["c_nationkey"], ["c_custkey"], columns, block_of("c_custkey"))


@query(
    f"""select number, number || '. ' || filename || ' (' || upper(file_type) || ')' || chr(10)
               || case when file_type in ('txt', 'py', 'code') then '   Lines: Unknown, Characters: ' || n_chars || chr(10)
                       when file_type = 'pdf' then '   Pages: Unknown, Tables: 0, Contains Images: False' || chr(10)
                       when file_type = 'docx' then '   Paragraphs: Unknown, Tables: 0' || chr(10) else '' end
               || '   Extracted: ' || n_chars || ' characters' || chr(10)
               || case when number < total then chr(10) else '' end as entry
        from (select {FILENAME_SQL} as filename, n_chars, count(*) over () as total,
                     row_number() over (order by doc_id) as number,
                     ['pdf', 'docx', 'py', 'zip', 'code', 'txt', 'excel', 'txt'][doc_id % 8 + 1] as file_type
              from documents)
        union all
        select 0, 'Processed ' || count(*) || ' files:' || chr(10) || chr(10) from documents"""
)
def file_summary(spark, sf_dir):
    files = documents(spark, sf_dir).select(
        "doc_id", filename_of().alias("filename"), text.file_type(filename_of()).alias("file_type"), "text",
        metadata_struct(characters=F.col("n_chars")).alias("metadata"),
    )
    return docs.file_summary(files, ["doc_id"])


def _echo():
    """A stand-in for a completion service: says how many words it was given."""

    def complete(prompt: str) -> dict:
        words = prompt.split()
        return {"content": f"{len(words)} words from {words[0] if words else ''}", "id": "echo"}

    return complete


@query(
    f"""select doc_id, segment_no, count(*) as pieces, string_agg(answer, chr(10) order by chunk_index) as text
        from (select *, {SEGMENT_SQL.format(size="length(answer) + 1", keys="doc_id", order="chunk_index")} as segment_no
              from (select doc_id, chunk_index, len(w) || ' words from ' || coalesce(w[1], '') as answer
                    from (select doc_id, chunk_index,
                                 list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') as w
                          from ({WORD_CHUNKS_SQL})))) group by 1, 2"""
)
def document_responses(spark, sf_dir):
    return completion.document_responses(spread_documents(spark, sf_dir), _echo, max_words=200, overlap=20)
