"""Splitting long text, and labelling the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import SPACE, once, strip, word_count, words

SENTENCE_END = f"(?<=[.!?])[{SPACE}]+"


def word_chunks(text: Column, max_words: int = 2000, overlap: int = 50) -> Column:
    """Windows of words as an array. Text within the limit stays untouched, spaces included."""
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least 0 and below max_words")

    def windows(split: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(split) - 1, F.lit(max_words - overlap))
        return F.transform(starts, lambda s: F.array_join(F.slice(split, s + 1, F.lit(max_words)), " "))

    return F.when(word_count(text) <= max_words, F.array(text)).otherwise(once(words(text), windows))


def _units(text: Column, limit: int) -> Column:
    """Paragraphs, or where too long sentences, or where too long words, with a
    break ``B`` ahead of each descent."""

    def unit(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    stop = F.array(unit("B", F.lit("")))

    def sentence(s: Column) -> Column:
        by_word = F.concat(stop, F.transform(words(s), lambda w: unit("W", w)))
        return F.when(F.length(s) <= limit, F.array(unit("S", s))).otherwise(by_word)

    def paragraph(p: Column) -> Column:
        by_sentence = F.concat(stop, F.flatten(F.transform(F.split(p, SENTENCE_END, -1), sentence)))
        return F.when(F.length(p) <= limit, F.array(unit("P", p))).otherwise(by_sentence)

    return F.flatten(F.transform(F.split(text, "\n\n", -1), paragraph))


def char_chunks(text: Column, max_chars: int = 4000, overlap: int = 200, drop_empty: bool = False) -> Column:
    """Greedy packing of paragraphs, sentences and words as an array of chunks.

    A chunk may pass the limit by its separators, its overlap or one long word; a
    word over the limit at the start of a sentence is preceded by an empty chunk.
    """

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"))

    def step(acc: Column, u: Column) -> Column:
        kind, value, open_ = u["kind"], u["value"], acc["open"]
        fits = F.length(open_) + F.length(value) <= max_chars
        closed = F.concat(acc["done"], F.array(open_))
        keep_empty = (kind == "W") & ~fits
        done = F.when(
            ((kind == "B") | ~fits) & ((open_ != "") | keep_empty), closed
        ).otherwise(acc["done"])
        tail = F.when(kind == "P", value).otherwise(F.concat(value, F.lit(" ")))
        grown = F.when(
            (kind == "P") & (open_ != ""), F.concat(open_, F.lit("\n\n"), value)
        ).otherwise(F.concat(open_, tail))
        return state(done, F.when(kind == "B", "").when(fits, grown).otherwise(tail))

    packed = F.aggregate(
        _units(text, max_chars),
        state(F.array().cast("array<string>"), F.lit("")),
        step,
        lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    if drop_empty:
        packed = F.filter(packed, lambda c: c != "")
    if overlap > 0:
        packed = once(
            packed,
            lambda chunks: F.transform(
                chunks,
                lambda c, i: F.when(i == 0, c).otherwise(
                    F.concat(F.right(F.get(chunks, i - 1), F.lit(overlap)), c)
                ),
            ),
        )
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


def exploded(df: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk: the columns of ``df`` without ``text``, then
    ``chunk_index`` (from 0), ``n_chunks`` and ``content``."""
    kept = [c for c in df.columns if c != "text"]
    # The array is built once, below the generator, and not again per output row.
    cut = df.withColumn("_chunks", chunks).select(*kept, F.size("_chunks").alias("n_chunks"), "_chunks")
    return _rows(cut, [*kept, "n_chunks"], F.col("_chunks"), "chunk_index", "content")


def _rows(df: DataFrame, kept: list[str], items: Column, position: str, item: str) -> DataFrame:
    """``posexplode``, by way of the outer form: for the inner one Spark adds a filter on
    the array ahead of everything, and so builds it several times over."""
    return df.select(*kept, F.posexplode_outer(items).alias(position, item)).where(F.col(position).isNotNull())


def chunk_words(df: DataFrame, max_words: int = 2000, overlap: int = 50) -> DataFrame:
    return exploded(df, word_chunks(F.col("text"), max_words, overlap))


def chunk_chars(df: DataFrame, max_chars: int = 4000, overlap: int = 200) -> DataFrame:
    return exploded(df, char_chunks(F.col("text"), max_chars, overlap))


def label_prompts(files: DataFrame, max_chars: int = 4000, overlap: int = 200, bare: bool = False) -> DataFrame:
    """Prompts from files: ``[name - Part i/n] chunk`` for long text, ``[name] text``
    for short, or the text alone (a combined or a single file)."""
    if bare:
        return files.select(
            *[c for c in files.columns if c != "text"],
            F.lit(0).alias("chunk_index"), F.lit(1).alias("n_chunks"), F.col("text").alias("prompt"),
        )
    cut = chunk_chars(files.withColumn("_long", F.length("text") > max_chars), max_chars, overlap)
    part = F.format_string(
        "[%s - Part %d/%d] %s", F.col("filename"), F.col("chunk_index") + 1, F.col("n_chunks"), F.col("content")
    )
    whole = F.concat(F.lit("["), F.col("filename"), F.lit("] "), F.col("content"))
    return cut.withColumn("prompt", F.when(F.col("_long"), part).otherwise(whole)).drop("_long", "content")


def split_prompts(df: DataFrame, mark: str = "---") -> DataFrame:
    """Text cut at the mark, trimmed, blanks dropped: ``prompt_no`` (from 0) and ``prompt``."""
    kept = [c for c in df.columns if c != "text"]
    trimmed = F.transform(F.split(F.col("text"), mark, -1), strip)
    parts = F.filter(trimmed, lambda p: p != "")
    return _rows(df, kept, parts, "prompt_no", "prompt")
