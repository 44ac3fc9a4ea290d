"""Repeated lines across documents: narrow rows of line hashes in, keep bitmaps of documents out.

Lines become rows of (hash, document, place) and move once, dealt by ranges of
the hash with document and place as secondary sort; walking a range once shows
in how many documents a line stands and which is the last. What comes back per
document is a bitmap of the lines it keeps, as runs; no text takes part until
the bitmaps are applied. A line that stands in very many documents is found
beforehand by a bounded summary and cut into parts by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import written

#: What is stripped from a line, and the letters that are lower-cased.
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A line with more than 1/PARTS of all rows is cut into parts. By counting there are fewer than PARTS such lines.
PARTS = 4096
#: Items of the summary that finds them; its error is below 1/PARTS of the rows.
TRACKED = 1 << 16


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def row_of(key: str, text: str) -> Column:
    """Tells rows with one key and different texts apart; rows equal in both have one verdict."""
    return F.xxhash64(key, text)


def hashed_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """``_h, _g, _doc, _row, _n, _at`` for each line whose key is long enough; two hashes stand for the key."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    said = line_key(F.col("_line"))
    return (
        docs.select(F.col(key).alias("_doc"), row_of(key, text).alias("_row"), lines.alias("_lines"))
        .select("_doc", "_row", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_at", "_line"))
        .where(F.length("_line") >= least_chars)
        .select("_doc", "_row", "_n", "_at", said.alias("_line"))
        .where(F.length("_line") >= least_chars)
        .select(
            F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), "_line").alias("_g"), "_doc", "_row", "_n", "_at"
        )
    )


def hot_lines(lines: DataFrame) -> DataFrame:
    """``_h, _fan``: hashes above 1/PARTS of the rows, and into how many parts to cut each; under PARTS rows."""
    found = lines.agg(F.expr(f"approx_top_k(_h, {PARTS}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_all"))
    return (
        found.select(F.explode("_top").alias("_t"), (F.col("_all") / PARTS).alias("_share"))
        .where(F.col("_t.count") > F.greatest("_share", F.lit(16.0)))
        .select(
            F.col("_t.item").alias("_h"),
            F.ceil(F.col("_t.count") / F.greatest("_share", F.lit(16.0))).cast("int").alias("_fan"),
        )
    )


def dropped_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """``_doc, _row, _n, _at`` of the lines that go."""
    hot = written(hot_lines(lines), "hot-lines")
    part = F.when(F.col("_fan").isNull(), 0).otherwise(F.pmod(F.xxhash64("_doc"), F.col("_fan")) + 1).cast("int")
    dealt = (
        lines.join(F.broadcast(hot), "_h", "left")
        .select("_h", "_g", part.alias("_part"), "_doc", "_row", "_n", "_at")
        .repartitionByRange("_h", "_g", "_part")
    )
    # The windows ask for rows of one (hash, part) together, which the ranges already give.
    together = Window.partitionBy("_h", "_g", "_part")
    falling = together.orderBy(F.col("_doc").desc_nulls_last(), "_row", "_at")
    walked = dealt.select(
        "*",
        F.first("_doc").over(falling).alias("_last"),
        # A new document begins where the one before differs.
        F.when(F.col("_doc").isNull(), 0)
        .when(F.lag("_doc").over(falling).eqNullSafe(F.col("_doc")), 0).otherwise(1).alias("_new"),
    ).withColumn("_docs", F.sum("_new").over(together))
    goes = (F.col("_docs") >= least_docs) & (F.col("_doc").isNull() | (F.col("_doc") < F.col("_last")))
    # Few rows: those that go, and all of hot lines, whose parts are put together first (one row per part).
    found = written(walked.where((F.col("_part") > 0) | goes).drop("_new"), "repeated-lines")
    parts = found.where("_part > 0")
    whole = (
        parts.groupBy("_h", "_g", "_part").agg(F.max("_docs").alias("_docs"), F.max("_last").alias("_last"))
        .groupBy("_h", "_g").agg(F.sum("_docs").alias("_docs"), F.max("_last").alias("_last"))
    )
    cut = parts.drop("_docs", "_last").join(F.broadcast(whole), ["_h", "_g"]).where(goes)
    kept = ["_doc", "_row", "_n", "_at"]
    return found.where("_part = 0").select(kept).unionByName(cut.select(kept))


def keep_runs(gone: Column, n: Column) -> Column:
    """A bitmap of ``n`` places as runs of kept ones, from the sorted places that are gone."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(n))
    between = F.transform(
        F.slice(ends, F.lit(2), F.size(gone) + 1),
        lambda end, i: F.struct((ends[i] + 1).alias("start"), (end - ends[i] - 1).alias("length")),
    )
    return F.filter(between, lambda run: run["length"] > 0)


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3
) -> DataFrame:
    """``_doc, _row, n_dropped, keep`` for each document that loses lines.

    A line's key is the line without blanks at both ends and with A-Z lower-cased.
    A key of at least ``least_chars`` code points in at least ``least_docs``
    documents loses all its lines except those in the document with the largest
    ``key`` that holds it. ``keep`` is the bitmap of the lines that stay, as runs
    (start from 0, length). A document without a row here keeps all of its lines.
    """
    lines = written(hashed_lines(docs, key, text, least_chars), "lines")
    # Rows equal in key and text are one row here: a set, so repeats do not add up.
    gone = dropped_lines(lines, least_docs).groupBy("_doc", "_row", "_n").agg(
        F.array_sort(F.collect_set("_at")).alias("_gone")
    )
    return gone.select(
        "_doc", "_row", F.size("_gone").cast("bigint").alias("n_dropped"), keep_runs(F.col("_gone"), F.col("_n")).alias("keep")
    )


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3
) -> DataFrame:
    """``key, n_lines, n_dropped, kept``: each text without the lines that other documents have, see ``keep_bitmaps``.

    A NULL or empty text is one empty line. Rows with one ``key`` count as one
    document, each with its own text; a row without a key is not counted as a
    document and loses every line that others lose. A very long text is one row
    per line until its bitmap is made. An empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    bitmaps = keep_bitmaps(docs, key, text, least_chars, least_docs).hint("shuffle_hash")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), row_of(key, text).alias("_mark"))
    joined = rows.join(bitmaps, F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_row")), "left")
    lines = F.split("_text", "\n", -1)
    # A run is a slice of the lines, so that the work is in proportion to the text.
    left = F.flatten(F.transform("keep", lambda run: F.slice(lines, run["start"] + 1, run["length"])))
    return joined.select(
        F.col("_key").alias(key),
        (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n")).alias("kept"),
    )
