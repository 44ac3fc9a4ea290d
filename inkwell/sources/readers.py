"""Reading a folder of mixed files, with decoders for binary types supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import ARCHIVE_MEMBER_LIMIT, member_type
from inkwell.operators.documents import combine_files, member_verdicts
from inkwell.sources.files import extract_text, file_id, metadata_struct, read_bytes, typed_files

# From files (path, filename, length, content, file_type) to filename, text, file_type,
# metadata. The reader for "zip" gives members: archive, rel_path, size, content.
Reader = Callable[[DataFrame], DataFrame]

TEXT_TYPES = ("txt", "py", "code")
MODES = ("separate", "combine", "zip")


class Readers:
    """Decoders by file type."""

    def __init__(self) -> None:
        self._readers: dict[str, Reader] = {}

    def register(self, file_type: str, reader: Reader) -> None:
        self._readers[file_type] = reader

    def read(self, file_type: str, files: DataFrame) -> DataFrame:
        if file_type in self._readers:
            return self._readers[file_type](files)
        message = F.lit(f"no reader registered for {file_type}")
        return files.select(
            "filename",
            F.concat(F.lit("Error processing file: "), message).alias("text"),
            F.lit("error").alias("file_type"),
            metadata_struct(filename=F.col("filename"), file_size=F.col("length"), error=message).alias("metadata"),
        )


def _read_members(files: DataFrame, readers: Readers, limit: int, with_skipped: bool) -> DataFrame:
    """Text members of archives; the name is the path inside the archive. On demand also what is skipped, and why."""
    found = member_verdicts(readers.read("zip", files), limit)
    members = found.where(F.col("skipped").isNull()).select(
        F.col("rel_path").alias("filename"), F.col("size").alias("length"), "content", member_type(F.col("rel_path")).alias("file_type")
    )
    done = _route(members, readers)
    if not with_skipped:
        return done
    left_out = found.where(F.col("skipped").isNotNull()).select(
        F.col("rel_path").alias("filename"),
        F.concat(F.lit("Skipped: "), F.col("skipped")).alias("text"),
        F.lit("skipped").alias("file_type"),
        metadata_struct(filename=F.col("rel_path"), file_size=F.col("size"), error=F.col("skipped")).alias("metadata"),
    )
    return done.unionByName(left_out)


def _route(files: DataFrame, readers: Readers) -> DataFrame:
    parts = extract_text(files.where(F.col("file_type").isin(*TEXT_TYPES)))
    for kind in ("pdf", "docx", "excel"):
        parts = parts.unionByName(readers.read(kind, files.where(F.col("file_type") == kind)))
    return parts


def process_files(
    spark: SparkSession, path: str, mode: str = "separate", readers: Readers | None = None, glob: str | None = None, **options: Any
) -> DataFrame:
    """Texts of a folder's files, as ``process_listed`` gives them."""
    return process_listed(read_bytes(spark, path, glob), mode, readers, **options)


def process_listed(
    files: DataFrame,
    mode: str = "separate",
    readers: Readers | None = None,
    member_limit: int = ARCHIVE_MEMBER_LIMIT,
    with_skipped: bool = False,
) -> DataFrame:
    """Texts of files (``filename, length, content``): ``filename, text, file_type, metadata, id, from_zip``.

    ``separate`` gives a row per file, ``zip`` also opens archives, ``combine``
    joins all texts in file-name order (``segment_no, files, text``). Members of
    archives above ``member_limit`` bytes, of unknown size or not text by name
    are left out; ``with_skipped`` gives a row of type ``skipped`` for each, with
    the reason.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    readers = readers or Readers()
    files = typed_files(files, archives=mode == "zip")
    done = _route(files, readers).withColumn("from_zip", F.lit(False))
    if mode == "zip":
        archives = files.where(F.col("file_type") == "zip")
        known = "zip" in readers._readers
        members = _read_members(archives, readers, member_limit, with_skipped) if known else readers.read("zip", archives)
        done = done.unionByName(members.withColumn("from_zip", F.lit(known)))
    if mode == "combine":
        return combine_files(done)
    return done.withColumn("id", file_id(F.col("filename"), F.col("text")))
