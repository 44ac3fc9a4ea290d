"""Quality rules against plain versions."""

import math
import re
from collections import Counter

import pytest

from inkwell.llm import quality


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.fixture(scope="module")
def repeats(spark):
    texts = [
        "a b c d e f a b c d e g", "a a a a a a a a", "a b c d e a b c d e a b c d e", "x\ny\nx\n\n \n \nx", "one two three four",
        "q w e r t " * 2 + "z " + "w e r t z " * 3, "long " * 9 + "tail", " ".join(f"w{i % 97}" for i in range(3000)),
        "a#b|c <d> &&& 50% $5 *", "tab\tsep\x0bwords\x0cand\rmore\n" * 3, " no break　ideographic a b c d e f g h",
    ]
    return spark.createDataFrame([(i, t, "en", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept double")


@pytest.mark.parametrize("name", ["odd", "repeats", "documents"])
def test_base_measures(request, name):
    docs = request.getfixturevalue(name)
    want = [(r["doc_id"], *plain_measures(r["text"])) for r in docs.collect()]
    got = quality.judge(docs)
    assert sorted((tuple(r[n] for n in ("doc_id", *NAMES)) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_divergence_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    counts, reference = [3, 0, 5, 2], [0.2, 0.3, 0.0, 0.5]
    p = [c / 10 for c in counts]
    mean = [(a + b) / 2 for a, b in zip(p, reference)]
    entropy = lambda xs: -sum(x * math.log2(x) for x in xs if x)
    want = math.sqrt(entropy(mean) - (entropy(p) + entropy(reference)) / 2)
    df = spark.createDataFrame([(counts,)], "c array<long>")
    assert df.select(quality.divergence(F.col("c"), F.lit(10), reference)).first()[0] == pytest.approx(want)


def test_odd_tables(spark, odd, none):
    assert quality.judge(none).count() == 0
    assert quality.keep(none).columns == none.columns
    no_language = quality.judge(odd.drop("lang"), lang=None).collect()
    assert all(r["class_distance"] is None and r["kept"] == (not r["base_failed"]) for r in no_language)


def test_short_texts_are_not_judged_by_distance(spark):
    # The sentence has the corpus' language; the shouted one has not, but is short.
    sentence = "the house of the man and a tree that is in it for this was on as they with by "
    rows = [(i, sentence + f"number{i}", "en") for i in range(50)] + [(90, "A B C D E F G H I J K L", "en"), (91, "ZXQ !! " * 60 + "end", "en")]
    rows += [(92, " ".join(f"Q{i}X|" for i in range(200)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert all(kept[i] for i in range(50)) and kept[90] and not kept[91] and not kept[92]
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == {i for i, k in kept.items() if k}


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.15 * len(bad)


def test_no_python_in_the_plan(odd):
    plan = quality.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
