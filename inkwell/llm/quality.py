"""Quality rules with distribution divergence, in DataFrame functions only.

A text is described by two histograms: its characters by class, and its words
by common word (all others together). For each language a reference is the sum
of both over the corpus' documents of that language. A text is kept if it passes
the base rules and, where it is long enough to judge, its Jensen-Shannon
distance from at least one language's reference is small for both histograms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bind
from inkwell.session import written

# White space, symbols, and common words of the languages that have a reference.
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with at be this from or by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
CLASSES = {"lower": r"[a-z]+", "upper": r"\p{Lu}+", "letter": r"\p{L}+", "digit": r"\p{N}+", "stop": r"[.,;:?'\"()-]+"}

WINDOW = 5
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Rules:
    """Greatest distances, and the lengths from which they are applied.

    A short text strays from its language by chance, about as one over the root
    of its length; ``allowance`` times that is added for characters.
    """

    classes: float = 0.13
    allowance: float = 2.2
    words: float = 0.325
    least_chars: int = 200
    least_words: int = 150


#: Shares of classes and of common words, by language.
References = dict[str, tuple[list[float], list[float]]]


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that stand twice or more in the text.

    A text whose window hashes all differ has none. In others the windows
    themselves are sorted, equal neighbours marked, and what the marked windows
    cover is counted, so the result does not rest on hashes.
    """

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[w[i + n] for n in range(WINDOW)]))

    def exact(w: Column, hashes: Column) -> Column:
        entry = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.slice(w, i + 1, WINDOW).alias("w"), i.alias("i")))
        return bind(F.sort_array(entry), lambda s: bind(places(s), covered))

    def places(s: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (a["w"] == b["w"])

        marked = F.filter(
            s, lambda x, k: ((k > 0) & equal(F.get(s, k - 1), x)) | ((k < F.size(s) - 1) & equal(F.get(s, k + 1), x))
        )
        return F.array_sort(F.transform(marked, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, n: a + n)

    def count(w: Column) -> Column:
        return bind(
            windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w, h)).otherwise(F.lit(0))
        )

    return bind(words, count).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def class_counts(joined: Column) -> Column:
    """Characters of each class of ``CLASSES``, in turn, then all others. Each class is taken out before the next is counted."""

    def step(rest: Column, patterns: list[str]) -> Column:
        if not patterns:
            return F.array(F.length(rest).cast("bigint"))
        return bind(
            F.regexp_replace(rest, patterns[0], ""),
            lambda less: F.concat(
                F.array((F.length(rest) - F.length(less)).cast("bigint")), step(less, patterns[1:])
            ),
        )

    return step(joined, list(CLASSES.values()))


def common_counts(words: Column) -> Column:
    """How often each word of the vocabulary stands among the words, in the vocabulary's order."""
    known = vocabulary()
    return bind(
        F.filter(words, lambda w: w.isin(known)),
        lambda found: F.transform(
            F.array(*map(F.lit, known)), lambda v: (F.size(found) - F.size(F.array_remove(found, v))).cast("bigint")
        ),
    )


def measured(body: Column) -> Column:
    """Base measures and both histograms of a text, as one struct."""

    def of_words(w: Column) -> Column:
        return bind(
            F.array_join(w, ""),
            lambda j: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(j).cast("bigint").alias("word_chars"),
                F.regexp_count(body, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
                duplicate_lines(body).alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                common_counts(w).alias("common"),
                class_counts(j).alias("classes"),
            ),
        )

    return bind(words_of(body), of_words)


def measures(docs: DataFrame, key: str | None, text: str, lang: str | None) -> DataFrame:
    """``_id, _lang, _m`` of every row, written."""
    body = F.coalesce(F.col(text), F.lit(""))
    language = F.col(lang) if lang else F.lit(None)
    names = [F.col(key).alias("_id")] if key else []
    return written(docs.select(*names, language.cast("string").alias("_lang"), measured(body).alias("_m")), "quality")


def references(rows: DataFrame) -> References:
    """Shares by language: classes, and common words with all others last. One row per language of the word lists."""
    sums = rows.where(F.col("_lang").isin(*COMMON_WORDS)).groupBy("_lang").agg(
        F.sum("_m.n_words").alias("n"),
        *[F.sum(F.col("_m.common")[i]).alias(f"w{i}") for i in range(len(vocabulary()))],
        *[F.sum(F.col("_m.classes")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)],
    )
    found = {}
    for r in sums.collect():
        words = [r[f"w{i}"] for i in range(len(vocabulary()))]
        classes = [r[f"c{i}"] for i in range(len(CLASSES) + 1)]
        if r["n"] and sum(classes):
            words.append(r["n"] - sum(words))
            found[r["_lang"]] = [c / sum(classes) for c in classes], [w / r["n"] for w in words]
    return found


def trimmed_references(rows: DataFrame, rules: Rules) -> References:
    """References of all documents are drawn towards junk; those of what they accept are not."""
    m, first = F.col("_m"), references(rows)
    return references(rows.where(~base_failed(m) & ~strange(m, first, rules)))


def divergence(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of counts from reference shares."""
    shares = F.array(*map(F.lit, reference))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    terms = F.zip_with(counts, shares, lambda c, q: bind(c / total, lambda p: part(p, q) + part(q, p)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def distances(m: Column, known: References) -> tuple[Column, Column]:
    """The least class and word distances over the references, NULL without any."""

    def least(found: list[Column]) -> Column:
        return F.least(*found) if len(found) > 1 else (found or [F.lit(None).cast("double")])[0]

    rest = m["n_words"] - F.aggregate(m["common"], F.lit(0).cast("bigint"), lambda a, n: a + n)
    words = F.concat(m["common"], F.array(rest))
    chars, some = F.greatest(m["word_chars"], F.lit(1)), F.greatest(m["n_words"], F.lit(1))
    return (
        least([divergence(m["classes"], chars, c) for c, _ in known.values()]),
        least([divergence(words, some, w) for _, w in known.values()]),
    )


def strange(m: Column, known: References, rules: Rules) -> Column:
    """Long enough to judge, and far from every reference."""
    classes, words = distances(m, known)
    bound = rules.classes + rules.allowance / F.sqrt(F.greatest(m["word_chars"], F.lit(1)))
    return F.coalesce(
        (m["word_chars"] >= rules.least_chars) & (classes > bound)
        | (m["n_words"] >= rules.least_words) & (words > rules.words),
        F.lit(False),
    )


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", rules: Rules = Rules()
) -> DataFrame:
    """``key``, the base measures, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept``, one row per row.

    Distances are the least over the languages with a reference; NULL without
    any, and a text below the minimum length or without a reference is judged by
    the base rules alone. ``lang`` only chooses whose documents make up which
    reference; NULL and unknown languages make up none. NULL and empty texts
    have no words and fail. Equal rows stay; other columns, whatever their
    names, are not read.
    """
    rows, m = measures(docs, key, text, lang), F.col("_m")
    known = trimmed_references(rows, rules)
    classes, words = distances(m, known)
    return rows.select(
        F.col("_id").alias(key), *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(m).alias("base_failed"), classes.alias("class_distance"), words.alias("word_distance"),
        (~base_failed(m) & ~strange(m, known, rules)).alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", lang: str | None = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows, with all their columns, that ``judge`` would keep; texts are measured again instead of moved."""
    known = trimmed_references(measures(docs, None, text, lang), rules)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.where(bind(measured(body), lambda m: ~base_failed(m) & ~strange(m, known, rules)))
