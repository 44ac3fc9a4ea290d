"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes what the one before kept and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import jaccard, packing, quality, secrets, toxicity
from inkwell.llm.queries import PACKING, not_held_out
from inkwell.plans.registry import table
from inkwell.session import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from those that came this far."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), not_held_out())
    return toxicity.keep_harmless(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates; those without shingles are alone.

    Rows equal in id and text are one document, of which one row stays.
    """
    own = F.xxhash64("doc_id", "text")
    keyed = docs.select(F.struct("doc_id", own.alias("row")).alias("_key"), "text")
    linked = written(jaccard.link_documents(keyed, key="_key"), "linked")
    kept = linked.where(F.col("_key") == F.col("component_id")).select(F.col("_key.row").alias("_row")).distinct()
    rows = docs.withColumn("_row", own)
    if not linked.groupBy("_key").count().where("count > 1").isEmpty():
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).where("_n = 1")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a batch."""
    return packing.length_buckets(docs, **PACKING)


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", keep_harmless),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", blank_secrets),
    ("packing", pack),
]

#: SQL cannot express the fits and the search for near duplicates; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
