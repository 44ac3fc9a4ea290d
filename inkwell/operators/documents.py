"""Documents from their decoded parts, archives, and joining files into text.

Byte decoders (PDF, DOCX, XLSX, ZIP) are handed in by the caller, see
``sources.readers``; the work here starts at pages, blocks, rows and members.
Texts come as ``segment_no, text``: one row unless a document is very large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import ARCHIVE_MEMBER_LIMIT, SPACE, base_name, member_is_text, member_type
from inkwell.operators.groups import (
    SEGMENT_CHARS,
    block_of,
    dense_index,
    ordered_segments,
    ordered_text,
)


def _table_rows(table: Column) -> Column:
    """Rows as ``a | b`` lines, NULL cells empty."""
    cells = F.transform(
        table,
        lambda row: F.concat(
            F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit("\n")
        ),
    )
    return F.array_join(cells, "")


def document_from_pages(
    pages: DataFrame, extract_tables: bool = False, segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """``doc_id, segment_no, text, pages, tables, has_images`` from page rows."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"))
    found = F.lit(0)
    if extract_tables:

        def titled(table: Column, i: Column) -> Column:
            title = F.format_string("\nTable %d-%d:\n", F.col("page_no"), i + 1)
            return F.when(F.size(table) > 0, F.concat(title, _table_rows(table), F.lit("\n"))).otherwise("")

        tables = F.coalesce("tables", F.array().cast("array<array<array<string>>>"))
        text = F.concat(text, F.array_join(F.transform(tables, titled), ""))
        found = F.size(tables)
    facts = {"pages": F.lit(1), "tables": found, "images": F.coalesce("has_images", F.lit(False)).cast("int")}
    texts = ordered_text(pages, ["doc_id"], ["page_no"], text, "", block_of("page_no"), segment_chars, facts=facts)
    return texts.select("doc_id", "segment_no", "text", "pages", "tables", (F.col("images") > 0).alias("has_images"))


def document_from_blocks(blocks: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``doc_id, segment_no, text, paragraphs, tables, has_images`` from block rows.

    Paragraphs that are not blank come first, then the tables, numbered.
    ``kind`` is ``paragraph``, ``table`` or ``image``.
    """
    is_table = F.coalesce(F.col("kind") == "table", F.lit(False))
    said = F.coalesce((F.col("kind") == "paragraph") & F.col("text").rlike(f"[^{SPACE}]"), F.lit(False))
    parts = blocks.withColumn("part", is_table.cast("int"))
    # Blocks of the second part follow all blocks of the first.
    span = F.col("part").cast("bigint") * F.lit(1 << 40) + block_of("seq")
    piece = F.when(is_table, F.concat(_table_rows(F.col("cells")), F.lit("\n"))).when(said, F.concat("text", F.lit("\n")))
    facts = {
        "paragraphs": said.cast("int"), "tables": is_table.cast("int"),
        "images": F.coalesce(F.col("kind") == "image", F.lit(False)).cast("int"),
    }
    texts = ordered_text(
        parts, ["doc_id"], ["part", "seq"], piece, "", span, segment_chars, facts=facts, skip_null=True, mark=F.col("part"),
        # Paragraphs count nothing, so what runs before a table is the number of tables.
        prefix=lambda before: F.when(F.col("part") == 1, F.format_string("\nTable %d:\n", before + 1)),
    )
    return texts.select(
        "doc_id", "segment_no", "text", "paragraphs", "tables", (F.col("images") > 0).alias("has_images")
    )


def table_text(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    block: Column,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Tabular rows as CSV text per file: ``keys, segment_no, text, rows, columns``.

    The header opens the first segment; every line ends with a newline.
    """
    options = {
        "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
        "emptyValue": "", "nullValue": "",
    }
    line = F.concat(F.to_csv(F.struct(*columns), options), F.lit("\n"))
    header = F.concat(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in columns]), options), F.lit("\n"))
    texts = ordered_text(rows, keys, order, line, "", block, segment_chars, facts={"rows": F.lit(1)})
    first = F.when(F.col("segment_no") == 0, F.concat(header, F.col("text"))).otherwise(F.col("text"))
    return texts.select(
        *keys, "segment_no", first.alias("text"), "rows", F.lit(len(columns)).cast("bigint").alias("columns")
    )


def member_verdicts(manifest: DataFrame, limit: int = ARCHIVE_MEMBER_LIMIT) -> DataFrame:
    """All members with ``skipped``: why one is not read, NULL for those that are.

    A member above ``limit`` bytes, one of unknown size, one that is not text by
    name and the archive itself are skipped.
    """
    path, size = F.col("rel_path"), F.col("size")
    return manifest.withColumn(
        "skipped",
        F.when(path.isNull(), "no name").when(base_name(path) == "archive.zip", "the archive itself")
        .when(~member_is_text(path), "not text by name").when(size.isNull(), "size unknown")
        .when(size > limit, "too large"),
    )


def archive_members(manifest: DataFrame, limit: int = ARCHIVE_MEMBER_LIMIT) -> DataFrame:
    """Members worth reading, with the type they are read as. What is left out is in ``member_verdicts``."""
    return member_verdicts(manifest, limit).where(F.col("skipped").isNull()).drop("skipped").select(
        "*", member_type(F.col("rel_path")).alias("file_type"), F.lit(True).alias("from_zip")
    )


def _blocked(
    files: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None
) -> tuple[DataFrame, Column]:
    """Without a block of its own, the order is cut by a dense index over all files."""
    if block is not None:
        return files, block
    return dense_index(files, [*keys, *order], "_at"), block_of("_at")


def combine_files(
    files: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("filename",),
    block: Column | None = None,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """All files of a group as one text, each under its heading: ``keys, segment_no, files, text``.

    ``files`` counts the files of the segment; ``combined_metadata`` lists them.
    """
    files, block = _blocked(files, keys, order, block)
    piece = F.concat(F.lit("\n\n==== FILE: "), F.col("filename"), F.lit(" ====\n\n"), F.coalesce("text", F.lit("")))
    return ordered_text(files, keys, order, piece, "", block, segment_chars).withColumnRenamed("pieces", "files")


def combined_metadata(
    files: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("filename",),
    block: Column | None = None,
    segment_items: int = 100_000,
) -> DataFrame:
    """Names and types of the combined files, in order: ``keys, segment_no, files, file_types, total_files``."""
    files, block = _blocked(files, keys, order, block)
    entry = F.struct("filename", "file_type")
    lists = ordered_segments(files, keys, order, entry, F.lit(1), block, segment_items, {"total_files": F.lit(1)})
    return lists.select(
        *keys, "segment_no", F.col("items.filename").alias("files"), F.col("items.file_type").alias("file_types"),
        "total_files",
    )


def file_summary(files: DataFrame, order: Sequence[str] = ("filename",)) -> DataFrame:
    """Numbered entries, ``number, entry``; ``number`` 0 is the heading. Joined in order
    with nothing between they are the summary text."""

    def shown(name: str, missing: str = "Unknown") -> Column:
        return F.coalesce(F.col(f"metadata.{name}").cast("string"), F.lit(missing))

    def flag(name: str) -> Column:
        return F.when(F.col(f"metadata.{name}"), "True").otherwise("False")

    facts = (
        F.when(
            F.col("file_type") == "pdf",
            F.concat(
                F.lit("   Pages: "), shown("pages"), F.lit(", Tables: "), shown("tables", "0"),
                F.lit(", Contains Images: "), flag("has_images"), F.lit("\n"),
            ),
        )
        .when(
            F.col("file_type") == "docx",
            F.concat(
                F.lit("   Paragraphs: "), shown("paragraphs"), F.lit(", Tables: "), shown("tables", "0"), F.lit("\n")
            ),
        )
        .when(
            F.col("file_type").isin("txt", "py", "code"),
            F.concat(F.lit("   Lines: "), shown("lines"), F.lit(", Characters: "), shown("characters"), F.lit("\n")),
        )
        .otherwise("")
    )
    sized = files.select(*order, *[c for c in ("filename", "file_type") if c not in order], facts.alias("_facts"),
                         F.length(F.coalesce("text", F.lit(""))).alias("_size"))
    total = files.agg(F.count(F.lit(1)).alias("_total"))
    numbered = dense_index(sized, order, "_idx").crossJoin(F.broadcast(total))
    number = (F.col("_idx") + 1).cast("bigint")
    entry = F.concat(
        number.cast("string"), F.lit(". "), F.coalesce("filename", F.lit("Unknown")), F.lit(" ("),
        F.upper(F.coalesce("file_type", F.lit("Unknown"))), F.lit(")\n"), F.col("_facts"),
        F.lit("   Extracted: "), F.col("_size").cast("string"), F.lit(" characters\n"),
        F.when(number < F.col("_total"), "\n").otherwise(""),
    )
    heading = F.when(F.col("_total") == 0, "No files processed.").otherwise(
        F.concat(F.lit("Processed "), F.col("_total").cast("string"), F.lit(" files:\n\n"))
    )
    return numbered.select(number.alias("number"), entry.alias("entry")).unionByName(
        total.select(F.lit(0).cast("bigint").alias("number"), heading.alias("entry"))
    )


def merge_chunks(
    answers: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    content: Column,
    block: Column,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Chunk answers joined by newlines; an absent answer keeps its place as an empty line."""
    return ordered_text(answers, keys, order, content, "\n", block, segment_chars)


def conversation_log(
    entries: DataFrame, keys: Sequence[str], order: Sequence[str], entry: Column, block: Column,
    segment_items: int = 100_000,
) -> DataFrame:
    """Ordered log entries per batch: ``keys, segment_no, items``."""
    return ordered_segments(entries, keys, order, entry, F.lit(1), block, segment_items)
