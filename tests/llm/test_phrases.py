"""Phrases against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, most=2000, share=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = []
    for (lang, gram), a in counts.items():
        if len(gram) < 2 or a < least:
            continue
        if len(gram) == 2 and any(
            lang == o and len(g) == 3 and b >= least and 100 * b >= share * a and gram in (g[:2], g[1:]) for (o, g), b in counts.items()
        ):
            continue
        cuts = []
        for k in range(1, len(gram)):
            left, right = counts[lang, gram[:k]], counts[lang, gram[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(gram), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, ranked = Counter(), []
    for lang, phrase, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= most:
            ranked.append((lang, ranks[lang], phrase, *rest))
    return ranked


def got(spark, rows, **limits):
    table = spark.createDataFrame([(t, l, 1, "x") for l, t in rows], "text string, lang string, rank int, phrase string")
    out = phrases.collocations(table.repartition(4), **limits)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, rows=300):
    random.seed(seed)
    words = ["of", "the", "New", "york", "Times", "é", "É", "x\x1f", "日本", "a-b", "'", "…"]
    ends = [" "] * 12 + ["  ", "\t", ".", ", ", "\n", "!?", "\x0b", " ;"]
    texts = []
    for _ in range(rows):
        size = random.randrange(25)
        body = "".join(random.choice([*words, "of", "of", "of", "new york times"]) + random.choice(ends) for _ in range(size))
        texts.append((random.choice(["en", "en", "en", "de", None, ""]), random.choice([body, body, body.upper(), None, ""])))
    return texts


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"least": 2}), (3, {"least": 1, "most": 7}), (4, {"share": 90})])
def test_against_plain(spark, seed, limits):
    rows = corpus(seed)
    want = plain(rows, **limits)
    assert want and got(spark, rows, **limits) == sorted(want)


def test_small_slices_chunks_and_ranges(spark, monkeypatch):
    """Sums handed on within a piece, texts cut between words, and streams cut anywhere give the same."""
    from pyspark.sql import functions as F

    rows = corpus(5, 60) + [("en", "of the new york times of the " * 40), ("en", "w" * 300 + " of the"), ("de", "x " * 500)]

    class Small(phrases.Slice):
        @property
        def full(self):
            return self.size >= 17

    texts = [(lang or "und", (text or "").encode()) for lang, text in rows]

    def summed(kind, chunk):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        total, piece = Counter(), kind()
        for lang, text in texts:
            for tokens, size in phrases.chunks(text):
                piece.add(lang, tokens, size)
                if piece.full:
                    for b in phrases.sums(piece, (1, 2, 3), None):
                        total.update({(r["lang"], r["phrase"]): 0 for r in b.to_pylist()})
                        for r in b.to_pylist():
                            total[r["lang"], r["phrase"]] += r["n"]
                    piece.carry_on()
            piece.end_text()
        for b in phrases.sums(piece, (1, 2, 3), None):
            for r in b.to_pylist():
                total[r["lang"], r["phrase"]] += r["n"]
        return total

    whole = summed(phrases.Slice, 1 << 20)
    assert summed(Small, 1 << 20) == whole and summed(phrases.Slice, 23) == whole and summed(Small, 9) == whole
    assert whole["de", "x x x"] >= 498

    # Ranges end inside hot words and pairs.
    counts = spark.createDataFrame(
        [(g, n, len(g.split(" "))) for (lang, g), n in whole.items() if lang == "en" and g], "phrase string, f long, k int"
    ).withColumn("lang", F.lit("en"))
    words = F.split("phrase", " ")
    wide = counts.select("lang", "phrase", "f", "k")
    monkeypatch.setattr(type(wide), "repartitionByRange", lambda self, *c, own=type(wide).repartitionByRange: own(self, 40, *c))
    for order, pick in ([F.get(words, F.lit(i)) for i in range(3)], lambda w: w), ([F.get(F.reverse(words), F.lit(i)) for i in range(3)], lambda w: w[::-1]):
        for r in phrases.with_parts(wide, [F.col("lang"), *order], "one", "two").collect():
            w = pick(r["phrase"].split(" "))
            assert r["one"] == whole["en", w[0]]
            if r["k"] == 3:
                assert r["two"] == whole["en", " ".join(pick(w[:2]))]


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F

    big = 3 * 10**14
    table = spark.createDataFrame([(big, big + 1, big + 7), (10, 10, 10), (11, 10**9, 10**6)], "a long, l long, r long")
    out = table.select("a", "l", "r", phrases.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in out)


def test_filter_lets_all_frequent_pairs_through(spark):
    pairs = [("en", f"w{i} v{i % 7}") for i in range(500)]
    passes = phrases.pair_filter(spark.createDataFrame(pairs, "lang string, phrase string"))
    piece = phrases.Slice()
    for lang, phrase in pairs:
        piece.add(lang, phrase.encode().split(b" "), 1)
    ids = piece.stream().reshape(-1, 2)
    assert passes(piece, [ids[:, 0], ids[:, 1]]).all()
    assert passes(piece, [ids[:, 1], ids[:, 0]]).mean() < 0.5
    none = phrases.pair_filter(spark.createDataFrame([], "lang string, phrase string"))
    assert not none(piece, [ids[:, 0], ids[:, 1]]).any()


def test_odd_and_empty_tables(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd, least=2).collect()) == sorted(plain(rows, least=2))
    assert phrases.collocations(none).count() == 0


def test_ngrams_are_packed_without_loss():
    top = (1 << phrases.ID_BITS) - 1
    packed, counts = phrases.ngrams(np.array([top, top, 5, 0, 5, top]), 0, 3)
    assert [x.tolist() for x in phrases.unpacked(packed, 3)] == [[top], [top], [5]] and counts.tolist() == [1]
