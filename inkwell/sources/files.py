"""Readers for prompt files, JSON lines, batch records and text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import (
    char_count,
    content_hash,
    definition_count,
    extension,
    file_type,
    line_count,
    strip,
    word_count,
)
from inkwell.operators.groups import dense_index
from inkwell.schemas import BATCH_RECORD, FILE_METADATA, RESULT_LINE, STORE_LINE
from inkwell.session import path_exists, written

#: Splits whose counts may be broadcast: about 100 MB of names and numbers.
MOST_SPLITS = 500_000


def _is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_system.getFileStatus(hadoop_path).isDirectory()


def prompt_lines(spark: SparkSession, path: str, glob: str = "*.txt", object_prefix: bool = False) -> DataFrame:
    """One trimmed prompt per non-blank line: ``prompt_idx, text, file_path``.

    A folder is read with ``glob``, not recursively. With ``object_prefix`` the
    glob is ignored and unreadable objects are skipped; a single file raises.
    The index follows file name, then place in the file.
    """
    if not object_prefix and not path_exists(spark, path):
        raise FileNotFoundError(f"Prompt source {path} not found")
    reader = spark.read
    if object_prefix:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    elif _is_directory(spark, path):
        reader = reader.option("pathGlobFilter", glob)
    pin_splits(spark)
    lines = reader.text(path).select(
        strip(F.col("value")).alias("text"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_at"),
    ).where(F.col("text") != "")
    return number_lines(lines, ["file_path", "_at"], "prompt_idx").select("prompt_idx", "text", "file_path")


def pin_splits(spark: SparkSession) -> None:
    """Keep the number of tasks that a scan is planned for, which else follows executors as they come and go."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def number_lines(lines: DataFrame, split: Sequence[str], out: str, most_splits: int = MOST_SPLITS) -> DataFrame:
    """Add a dense number, from 0, to lines as they lie in their file splits, which ``split`` names in order.

    A task reads a split from its first line to its last, so a line's place is
    told by counting; what has to be known of the splits before is one row per
    split, in order. Lines are not moved or sorted. The scan runs twice, once for
    the counts, and must be cut into the same splits both times: should settings
    of the session have changed in between, it raises. With more than
    ``most_splits`` splits the lines are sorted and written instead.
    """
    # After the filter, so that only lines that count are counted.
    placed = lines.withColumn("_line", F.monotonically_increasing_id())
    counts = written(placed.groupBy(*split).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n")), "splits")
    if counts.count() > most_splits:
        return dense_index(placed, [*split, "_line"], out).drop("_line")
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_line") - F.col("_first")
    changed = F.raise_error(F.lit("the splits of the files have changed since their lines were counted"))
    return (
        placed.join(F.broadcast(offsets), list(split), "left")
        .withColumn(out, F.when((place >= 0) & (place < F.col("_n")), F.col("_offset") + place).otherwise(changed).cast("bigint"))
        .drop("_line", "_first", "_n", "_offset")
    )


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType = RESULT_LINE, missing_is_empty: bool = False
) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, a bad line raises."""
    if missing_is_empty and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Kept prompts and responses; none yet is an empty table."""
    return read_jsonl(spark, path, STORE_LINE, missing_is_empty=True)


def read_results(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """Stored results, of one batch or all, with ``batch_id`` from the folder."""
    schema = T.StructType([*RESULT_LINE.fields, T.StructField("batch_id", T.StringType())])
    rows = read_jsonl(spark, path, schema, missing_is_empty=True)
    return rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)


def _plain_name(uri_name: Column) -> Column:
    return F.url_decode(F.replace(uri_name, F.lit("+"), F.lit("%2B")))


def read_batch_records(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON record per batch; the id is the file name, unreadable files are left out,
    missing fields take their defaults. ``results`` and ``errors`` are arrays here;
    ``child_rows`` turns them into tables."""
    records = (
        spark.read.schema(BATCH_RECORD)
        .option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("_file", F.col("_metadata.file_name"))
        .where(F.col("_corrupt_record").isNull())
    )

    def default(name: str, value: Column) -> Column:
        return F.coalesce(name, value).alias(name)

    def empty(name: str) -> Column:
        return F.array().cast(BATCH_RECORD[name].dataType)

    return records.select(
        F.regexp_replace(_plain_name(F.col("_file")), r"\.json$", "").alias("id"),
        default("status", F.lit("unknown")),
        "created_at", "model",
        default("request_count", F.lit(0).cast("bigint")),
        default("last_updated", F.col("created_at")),
        default("metadata", F.create_map().cast("map<string,string>")),
        default("results", empty("results")),
        default("errors", empty("errors")),
    )


def child_rows(records: DataFrame, name: str) -> DataFrame:
    """``results`` or ``errors`` of batch records as rows with ``batch_id``."""
    return records.select(F.col("id").alias("batch_id"), F.explode(name).alias("_r")).select("batch_id", "_r.*")


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``name, path, length, modified``; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), "path", "length",
        F.col("modificationTime").alias("modified"),
    )


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Batch input files, ``id, path, length, modified``."""
    files = list_files(spark, folder, "batch_*.jsonl")
    return files.select(F.regexp_replace("name", r"\.jsonl$", "").alias("id"), "path", "length", "modified")


def read_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files: ``path, filename, length, content``, and ``listed_name`` to filter by.

    A filter on ``listed_name`` (the name as a URI) is applied to the listing, so
    files it leaves out are never opened.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.substring_index("path", "/", -1).alias("filename"), "length", "content",
        F.col("_metadata.file_name").alias("listed_name"),
    )


def content_digest(files: DataFrame) -> DataFrame:
    """``path, filename, digest``: MD5 of the raw bytes."""
    return files.select("path", "filename", F.md5("content").alias("digest"))


def metadata_struct(**known: Column) -> Column:
    """The wide metadata struct with the given fields; the others are NULL."""
    return F.struct(
        *[
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FILE_METADATA.fields
        ]
    )


def extract_text(files: DataFrame) -> DataFrame:
    """Text and statistics of txt, py and code files: ``filename, text, file_type, metadata``.

    ``files`` has ``filename, length, content, file_type``. Bytes that are not
    UTF-8 give an error text and ``metadata.error``; the row stays.
    """
    raw = F.col("content").cast("string")
    kind, ext = F.col("file_type"), extension(F.col("filename"))
    label = (
        F.when(kind == "py", "Python file").when(kind == "code", F.concat(F.upper(ext), F.lit(" file"))).otherwise("TXT")
    )
    valid = F.is_valid_utf8(raw)
    text = F.when(valid, raw)
    error = F.when(~valid, "invalid UTF-8")
    failure = F.concat(F.lit("Error extracting text from "), label, F.lit(": "), error)
    is_py, is_code = kind == "py", kind == "code"
    metadata = metadata_struct(
        filename=F.col("filename"),
        file_size=F.col("length"),
        processed_at=F.current_timestamp(),
        lines=line_count(text),
        characters=char_count(text),
        words=F.when(valid & ~is_py & ~is_code, word_count(text)),
        classes=F.when(is_py, definition_count(text, "class")),
        functions=F.when(is_py, definition_count(text, "def")),
        extension=F.when(is_code & valid, ext),
        error=error,
    )
    return files.select("filename", F.coalesce(text, failure).alias("text"), "file_type", metadata.alias("metadata"))


def typed_files(files: DataFrame, archives: bool) -> DataFrame:
    """Add ``file_type``; filtering files by it prunes the listing."""
    name = "listed_name" if "listed_name" in files.columns else "filename"
    return files.withColumn("file_type", file_type(F.col(name), archives))


def file_id(*parts: Column) -> Column:
    """An id that a rerun gives again."""
    return content_hash(F.concat_ws("\u001f", *parts))


def default_prompts(spark: SparkSession, system_path: str, user_path: str) -> DataFrame:
    """One row: ``system, user``, each a whole file."""
    system = spark.read.text(system_path, wholetext=True).withColumnRenamed("value", "system")
    user = spark.read.text(user_path, wholetext=True).withColumnRenamed("value", "user")
    return system.crossJoin(F.broadcast(user))  # two single-row tables


def recent_rows(rows: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` rows in ascending order: a report, so the limit is the feature."""
    newest = rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return newest.orderBy(*order)


def recent_lines(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """Last lines of a log, ``line``; a missing log is one row saying so."""
    if not path_exists(spark, path):
        return spark.createDataFrame([("No log file found",)], "line string")
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_no"),
    )
    return recent_rows(lines, ["_f", "_at", "_no"], n).select("line")
