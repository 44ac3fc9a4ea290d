"""Registration of queries with their SQL, and columns derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.groups import SEGMENT_CHARS
from inkwell.session import ship_package, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must agree with it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODELS = ("o1-pro", "o1-mini", "gpt-4o-mini", "gpt-4-turbo", "GPT-3.5-Turbo", "o3-mini")
SUFFIXES = (".pdf", ".DOCX", ".py", ".zip", ".html", ".txt", ".xls", "")
STATUSES = ("completed", "completed", "in_progress", "failed")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def pick_sql(values: tuple[str, ...], number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({number}) % {len(values)} + 1]"


def model_of(key: str = "doc_id") -> Column:
    return pick(MODELS, F.col(key))


def filename_of(key: str = "doc_id") -> Column:
    return F.concat(F.lit("f"), F.col(key).cast("string"), pick(SUFFIXES, F.col(key)))


MODEL_SQL = pick_sql(MODELS, "doc_id")
FILENAME_SQL = f"'f' || doc_id || {pick_sql(SUFFIXES, 'doc_id')}"
TOKENS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"
WORDS_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
SEGMENT_SQL = (
    "cast(coalesce(sum({size}) over (partition by {keys} order by {order} "
    f"rows between unbounded preceding and 1 preceding), 0) // {SEGMENT_CHARS} as bigint)"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is long per row."""
    return spread(documents(spark, sf_dir).select("doc_id", "text", "n_chars"), "doc_id")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text")


def source_number(column: str = "source") -> Column:
    return F.regexp_extract(column, r"(\d+)$", 1).cast("int")


def source_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per document source."""
    n = source_number("id")
    return (
        documents(spark, sf_dir)
        .groupBy(F.col("source").alias("id"))
        .agg(F.count(F.lit(1)).alias("request_count"))
        .select(
            "id",
            pick(STATUSES, n).alias("status"),
            F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T06:30:00Z")).alias(
                "created_at"
            ),
            pick(MODELS, n).alias("model"),
            "request_count",
        )
    )


BATCHES_SQL = f"""
batches as (
  select source as id,
         {pick_sql(STATUSES, "n")} as status,
         '2024-01-' || lpad(cast(n % 28 + 1 as varchar), 2, '0') || 'T06:30:00Z' as created_at,
         {pick_sql(MODELS, "n")} as model,
         request_count
  from (select source, cast(regexp_extract(source, '(\\d+)$', 1) as int) as n, count(*) as request_count
        from documents group by source)
)"""


def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: documents labelled good, as flat result rows of their source's batch."""
    from inkwell.functions.text import token_count

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    # Counted before the join, so that no text goes through it.
    counted = documents(spark, sf_dir).select(
        "doc_id", "source", "lang", token_count(F.col("text")).alias("tokens"),
        F.floor(F.col("n_chars") / 4).cast("bigint").alias("output"),
    )
    tokens, output = F.col("tokens"), F.col("output")
    return counted.join(good, "doc_id").select(
        F.col("source").alias("batch_id"),
        F.col("doc_id").cast("string").alias("custom_id"),
        model_of().alias("model"),
        F.col("lang").alias("content"),
        tokens.alias("input_tokens"),
        output.alias("output_tokens"),
        (F.col("doc_id") % 100).alias("reasoning_tokens"),
        (tokens + output).alias("total_tokens"),
    )


def flat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return documents(spark, sf_dir).join(bad, "doc_id").select(
        F.col("source").alias("batch_id"), F.col("doc_id").cast("string").alias("custom_id")
    )


CHILDREN_SQL = f"""
results as (
  select source as batch_id, cast(doc_id as varchar) as custom_id, {MODEL_SQL} as model, lang as content,
         cast({TOKENS_SQL} as bigint) as input_tokens, n_chars // 4 as output_tokens,
         doc_id % 100 as reasoning_tokens,
         cast({TOKENS_SQL} as bigint) + n_chars // 4 as total_tokens
  from documents join labels using (doc_id) where quality = 1
),
errors as (
  select source as batch_id, cast(doc_id as varchar) as custom_id
  from documents join labels using (doc_id) where quality = 0
)"""

PRICED_SQL = """
(case when contains(lower({m}), 'o1-pro') then 75 when contains(lower({m}), 'o1-mini') then 8
      when contains(lower({m}), 'gpt-4o') then 3 when contains(lower({m}), 'gpt-4') then 15
      when contains(lower({m}), 'gpt-3.5-turbo') then 0.5 else 10 end) as input_price,
(case when contains(lower({m}), 'o1-pro') then 300 when contains(lower({m}), 'o1-mini') then 12
      when contains(lower({m}), 'gpt-4o') then 15 when contains(lower({m}), 'gpt-4') then 30
      when contains(lower({m}), 'gpt-3.5-turbo') then 1.5 else 30 end) as output_price,
(case when contains(lower({m}), 'o1-pro') then 300 when contains(lower({m}), 'o1-mini') then 12
      else 0 end) as reasoning_price
"""
