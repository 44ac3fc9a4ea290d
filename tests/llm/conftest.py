import pytest

#: Texts that every operator must take: NULL, empty, blank, ties, repeats, odd characters.
ODD = [
    None, "", " ", "\n\t ", "a", "word", "same text here", "same text here", "It's  a\ttest\r\n\r\n42 times, isn't it?",
    "ÀÉÎ ß ĳ ΣΑΣ σας İstanbul ﬁ ② ½ 3٣ 你好 ​﻿ 😀", "é 가 Å Ω", "\x00\x07\x1c\x1f \x85 \xa0  x",
    "<|endoftext|> a<|endoftext|>b <|startoftext|><|EndOfText|>", "aaaaaaaaaaaaaaa ababababab !?!?!?!?", "x" * 3000, "ab cd " * 4000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with ids, a NULL id, a repeated row, and columns named as results are."""
    rows = [(i, t, "x", 0, [1], "y") for i, t in enumerate(ODD)]
    rows += [(3, ODD[3], "x", 0, [1], "y"), (None, "no id at all", "x", 0, [1], "y"), (8, ODD[8], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_tokens int, ids array<int>, lang string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 1000")


def as_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
