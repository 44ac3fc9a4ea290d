"""Phrases whose words go together, from sorted streams of n-gram counts.

Tasks count n-grams slice by slice and hand on sums, which are added up per
n-gram. What is frequent is then kept as two sorted streams: in prefix order
(first word first) every n-gram comes after its own beginnings, in suffix order
(last word first) after its own ends. One walk along a stream therefore knows the
counts of all parts by carrying the last shorter n-gram along; nothing is looked
up. A stream is cut into ranges anywhere, also inside a hot word; what a range
has to know of those before it is one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches
from inkwell.session import written

#: A-Z are lower-cased; these end a piece, and a tab parts words as a blank does.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PARTED = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
NO_LANGUAGE = "und"

#: A task counts so many words or bytes at a time, then hands its sums on.
SLICE_WORDS = 1_000_000
SLICE_BYTES = 12 << 20
#: A text is cut up so many bytes at a time, between words.
CHUNK = 1 << 20
#: Bits of a word's number in a slice; three numbers fit into 64 bits.
ID_BITS = 21
MOST_IDS = 1 << ID_BITS - 1
#: The filter of frequent pairs has at most 2^27 bits (16 MB); a fuller one lets more through, which costs time only.
MOST_FILTER_BITS = 27
BUCKET = 1 << 15


class Numbers(dict):
    """Numbers of one language's words in a slice; 0 ends a piece and -1 is no word."""

    def __init__(self, language: int, words: list[bytes], languages: list[int]):
        super().__init__({b"": -1, b"\n": 0})
        self.language, self.words, self.languages = language, words, languages

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.languages.append(self.language)
        return number


def chunks(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text and ends of pieces, chunk by chunk, with the bytes of each chunk."""
    text = text.lower().translate(PARTED)  # bytes.lower() knows A-Z only
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            cut = max(text.rfind(b" ", at, at + CHUNK), text.rfind(b"\n", at, at + CHUNK))
            if cut < 0:  # one very long word
                after = [n for n in (text.find(b" ", at + CHUNK), text.find(b"\n", at + CHUNK)) if n >= 0]
                cut = min(after, default=end - 1)
            end = cut + 1
        yield text[at:end].replace(b"\n", b" \n ").split(b" "), end - at
        at = end


class Slice:
    """Words met since the last sums were handed on, as numbers in order."""

    def __init__(self) -> None:
        self.open(())

    def open(self, context) -> None:
        """Start anew; ``context`` are the last two words of the piece that goes on."""
        self.words: list[bytes] = [b""]
        self.languages: list[int] = [0]
        self.names: list[str] = []
        self.numbers: dict[str, Numbers] = {}
        self.parts = [np.array([self.of(name)[word] for name, word in context], np.int64)]
        self.context, self.size, self.bytes = len(context), 0, 0

    def of(self, language: str) -> Numbers:
        numbers = self.numbers.get(language)
        if numbers is None:
            numbers = self.numbers[language] = Numbers(len(self.names), self.words, self.languages)
            self.names.append(language)
        return numbers

    def add(self, language: str, tokens: list[bytes], size: int) -> None:
        part = np.fromiter(map(self.of(language).__getitem__, tokens), np.int64, len(tokens))
        self.parts.append(part[part >= 0])
        self.size += len(part)
        self.bytes += size

    def end_text(self) -> None:
        self.parts.append(np.zeros(1, np.int64))

    @property
    def full(self) -> bool:
        return self.size >= SLICE_WORDS or self.bytes >= SLICE_BYTES or len(self.words) >= MOST_IDS

    def stream(self) -> np.ndarray:
        self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def carry_on(self) -> None:
        """Forget all but the last two words of an open piece."""
        last = self.stream()[-2:].tolist()
        last = last[last.index(0) + 1 :] if 0 in last[:1] else last
        last = [] if last and last[-1] == 0 else last
        self.open([(self.names[self.languages[i]], self.words[i]) for i in last])


def ngrams(stream: np.ndarray, start: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams within pieces that begin at ``start`` or later, packed into one number, and their counts."""
    size = max(0, len(stream) - start - order + 1)
    packed, whole = np.zeros(size, np.int64), np.ones(size, bool)
    for n in range(order):
        ids = stream[start + n : start + n + size]
        packed = (packed << ID_BITS) | ids
        whole &= ids > 0
    return np.unique(packed[whole], return_counts=True)


def unpacked(packed: np.ndarray, order: int) -> list[np.ndarray]:
    return [(packed >> ID_BITS * n) & ((1 << ID_BITS) - 1) for n in reversed(range(order))]


def word_hash(language: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, sum(language.encode()))


def pair_place(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Place in a filter of ``2^bits`` of pairs of hashed words."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(maxsize=1)
def as_bits(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.uint8)


def sums(piece: Slice, orders: tuple[int, ...], passes: Callable | None) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, n`` of a slice; the empty phrase counts all words of a language."""
    stream, words = piece.stream(), pa.array(piece.words, pa.binary())
    names, of = pa.array(piece.names, pa.string()), np.array(piece.languages)
    for order in orders:
        # Context words were counted before: only n-grams with a new word count.
        packed, counts = ngrams(stream, max(0, piece.context - order + 1), order)
        ids = unpacked(packed, order)
        if passes is not None and len(packed):
            keep = passes(piece, ids)
            ids, counts = [i[keep] for i in ids], counts[keep]
        if order == 1 and len(packed):
            total = np.bincount(of[ids[0]], weights=counts, minlength=len(names)).astype(np.int64)
            met = np.flatnonzero(total)
            yield batch(names.take(pa.array(met)), pa.array([""] * len(met), pa.string()), total[met])
        step = max(1, min(1 << 16, (1 << 26) // (1 + max(map(len, piece.words)))))
        for at in range(0, len(counts), step):
            taken = [words.take(pa.array(i[at : at + step])) for i in ids]
            phrase = pc.binary_join_element_wise(*taken, b" ") if order > 1 else taken[0]
            yield batch(names.take(pa.array(of[ids[0][at : at + step]])), phrase.cast(pa.string()), counts[at : at + step])


def batch(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def counted(docs: DataFrame, orders: tuple[int, ...], least: int, passes: Callable | None = None) -> DataFrame:
    """``lang, phrase, f`` of n-grams with ``f`` of at least ``least``; the empty phrase has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = Slice()
        for rows in batches:
            for language, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                for tokens, size in chunks(text.as_py() or b""):
                    piece.add(language, tokens, size)
                    if piece.full:
                        yield from sums(piece, orders, passes)
                        piece.carry_on()
                piece.end_text()
        yield from sums(piece, orders, passes)

    found = docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return written(found.where((F.col("f") >= least) | (F.col("phrase") == "")), "ngrams")


def pair_filter(pairs: DataFrame) -> Callable:
    """A test of n-grams for frequent pairs of neighbours. Never wrong about a frequent pair."""
    bits = min(MOST_FILTER_BITS, max(15, (16 * pairs.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashed = [
                [word_hash(language, w.encode()) for w in phrase.split(" ")]
                for language, phrase in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())
            ]
            first, second = np.array(hashed, np.uint64).reshape(-1, 2).T
            place = pair_place(first, second, bits)
            yield pa.RecordBatch.from_arrays([pa.array(place // BUCKET), pa.array(place % BUCKET)], names=["bucket", "place"])

    # At most 2^27 / 2^15 rows of 4 KB, whatever the number of pairs.
    parts = (
        pairs.select("lang", "phrase").mapInArrow(places, "bucket long, place long")
        .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect()
    )
    content = bytearray(max(BUCKET, 1 << bits) // 8)
    for r in parts:
        content[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = r["bits"]
    shared = pairs.sparkSession.sparkContext.broadcast(bytes(content))

    def passes(piece: Slice, ids: list[np.ndarray]) -> np.ndarray:
        known = as_bits(shared.value)
        hashed = np.fromiter(
            (word_hash(piece.names[n], w) for n, w in zip(piece.languages, piece.words)) if piece.names else (), np.uint64,
            len(piece.words) if piece.names else 0,
        )
        keep = np.ones(len(ids[0]), bool)
        for a, b in zip(ids, ids[1:]):
            place = pair_place(hashed[a], hashed[b], bits)
            keep &= known[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
        return keep

    return passes


def with_parts(counts: DataFrame, order: list[Column], one: str, two: str) -> DataFrame:
    """Add the counts of each n-gram's first word and first two words along ``order``, where shorter ones come first.

    Every part of a frequent n-gram is frequent, so the last one-word row before
    an n-gram in the stream is its own first word, and the last two-word row is
    its own first pair. Ranges are walked at once; what the first rows of a range
    miss is in the last rows of the ranges before.
    """
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = {1: None, 2: None}, 0
        for rows in batches:
            size, f, k = rows.num_rows, rows.column("f"), rows.column("k").to_numpy()
            places = np.arange(size)
            found = []
            for n in (1, 2):
                head = np.maximum.accumulate(np.where(k == n, places, -1)) if size else places
                carried = f.take(pa.array(np.maximum(head, 0)))
                found.append(pc.if_else(pa.array(head >= 0), carried, pa.scalar(last[n], pa.int64())))
                if size and head[-1] >= 0:
                    last[n] = f[int(head[-1])].as_py()
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(places + seen, pa.int64()), *found], names=[*rows.schema.names, "_at", one, two]
            )
            seen += size

    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in ranged.schema)
    walked = written(ranged.mapInArrow(run, f"{kinds}, _at long, {one} long, {two} long"), "stream")

    def end(n: int) -> Column:
        return F.max_by(F.when(F.col("k") == n, F.col("f")), F.when(F.col("k") == n, F.col("_at")))

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    ends = walked.groupBy("_part").agg(end(1).alias("_e1"), end(2).alias("_e2")).select(
        "_part", *[F.last(e, ignorenulls=True).over(before).alias(c) for e, c in (("_e1", "_c1"), ("_e2", "_c2"))]
    )
    return walked.join(F.broadcast(ends), "_part").select(
        *counts.columns, F.coalesce(one, "_c1").alias(one), F.coalesce(two, "_c2").alias(two)
    )


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in decimals of 38 digits: exact for counts below 10^15."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(18,0)")

    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, most: int = 2000, share: int = 50
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``most`` phrases that hold together best.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks
    and tabs. Candidates have 2 or 3 words and ``a`` of at least ``least``
    occurrences, overlapping ones included. A candidate cut in two of ``l`` and
    ``r`` occurrences scores ``floor(1000000 a a / (l r))``; its lowest cut counts,
    of equal ones the one with the shorter left part. A candidate is left out
    where a longer one that holds it has ``share`` percent of its occurrences or
    more. Ranks from 1 by score, then ``a``, both falling, then phrase in byte
    order. ``n`` is the number of words of the language. NULL languages are one,
    ``und``; NULL and empty texts have no words; repeated rows count again; a
    very long text is counted in parts without losing the phrases across them;
    an empty table gives no rows. Other columns, whatever their names, are not
    read.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("binary").alias("text"))
    short = counted(source, (1, 2), least)
    words = F.split("phrase", " ", -1)
    sized = short.where("phrase <> ''").withColumn("k", F.size(words))
    long = counted(source, (3,), least, pair_filter(sized.where("k = 2"))).withColumn("k", F.size(words))
    grams = sized.unionByName(long)
    word = [F.get(words, F.lit(n)) for n in range(3)]
    backwards = [F.get(F.reverse(words), F.lit(n)) for n in range(3)]
    forth = with_parts(grams, [F.col("lang"), *word], "p1", "p2")
    both = written(with_parts(forth, [F.col("lang"), *backwards], "s1", "s2"), "phrases")
    a, three = F.col("f"), F.col("k") == 3
    # A phrase of three words knows the counts of the two pairs it holds.
    held = F.array(
        F.when(100 * a >= share * F.col("p2"), F.concat_ws(" ", word[0], word[1])),
        F.when(100 * a >= share * F.col("s2"), F.concat_ws(" ", word[1], word[2])),
    )
    covered = both.where(three).select("lang", F.explode(held).alias("phrase")).where("phrase is not null")
    first = F.struct(exact_score(a, F.col("p1"), F.when(three, F.col("s2")).otherwise(F.col("s1"))).alias("score"),
                     F.col("p1").alias("l"), F.when(three, F.col("s2")).otherwise(F.col("s1")).alias("r"))
    second = F.struct(exact_score(a, F.col("p2"), F.col("s1")).alias("score"), F.col("p2").alias("l"), F.col("s1").alias("r"))
    cut = F.when(three & (second["score"] < first["score"]), second).otherwise(first)
    scored = (
        both.where("k > 1").join(covered.hint("merge"), ["lang", "phrase"], "left_anti")
        .select("lang", "phrase", a.alias("a"), cut.alias("_cut"))
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    total = short.where("phrase = ''").select("lang", F.col("f").alias("n"))  # one row per language
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
