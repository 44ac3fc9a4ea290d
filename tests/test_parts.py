"""Chunkers and documents from parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunking, documents
from inkwell.operators.groups import block_of


def test_word_chunks(column):
    def cut(size, overlap):
        return lambda c: chunking.word_chunks(c, size, overlap)

    nine = " ".join(f"w{i}" for i in range(9))
    assert column(cut(5, 1), [nine]) == [["w0 w1 w2 w3 w4", "w4 w5 w6 w7 w8", "w8"]]
    assert column(cut(5, 0), ["", "a  b  c"]) == [[""], ["a  b  c"]]
    with pytest.raises(ValueError):
        chunking.word_chunks(F.col("v"), 5, 5)


def by_hand_words(text, size, overlap):
    words = text.split()
    if len(words) <= size:
        return [text]
    return [" ".join(words[s : s + size]) for s in range(0, len(words), size - overlap)]


CASES = [
    ("abcdefghijklm xyz", 10, 0, ["", "abcdefghijklm ", "xyz "]),
    ("abcdefghijklm xyz", 10, 3, ["", "abcdefghijklm ", "lm xyz "]),
    ("aaa\n\nbbb\n\ncccc dddd. ee ff", 8, 2, ["aaa\n\nbbb", "bbcccc ", "c dddd. ", ". ee ff "]),
    ("abcd\n\nefgh\n\nij", 8, 0, ["abcd\n\nefgh", "ij"]),
    ("One two. Three four! Five?", 12, 4, ["One two. ", "wo. Three four! ", "ur! Five? "]),
    ("short", 10, 2, ["short"]),
    ("", 10, 2, [""]),
]


@pytest.mark.parametrize("text,limit,overlap,want", CASES)
def test_char_chunks(column, text, limit, overlap, want):
    assert column(lambda c: chunking.char_chunks(c, limit, overlap), [text]) == [want]


def test_char_chunks_drop_empty(column):
    got = column(lambda c: chunking.char_chunks(c, 10, 0, drop_empty=True), ["abcdefghijklm xyz"])
    assert got == [["abcdefghijklm ", "xyz "]]


class ByHand:
    """The packing rules, written as a plain state machine for comparison."""

    def __init__(self, limit):
        self.limit, self.done, self.open = limit, [], ""

    def close(self, even_empty=False):
        if self.open or even_empty:
            self.done.append(self.open)
        self.open = ""

    def add(self, piece, joiner, tail, even_empty=False):
        if len(self.open) + len(piece) > self.limit:
            self.close(even_empty)
        self.open += (joiner if self.open else "") + piece + tail

    def run(self, text, overlap):
        if len(text) <= self.limit:
            return [text]
        for paragraph in text.split("\n\n"):
            if len(paragraph) <= self.limit:
                self.add(paragraph, "\n\n", "")
                continue
            self.close()
            for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                if len(sentence) <= self.limit:
                    self.add(sentence, "", " ")
                    continue
                self.close()
                for word in sentence.split():
                    self.add(word, "", " ", even_empty=True)
        self.close()
        return [(self.done[i - 1][-overlap:] if i and overlap else "") + c for i, c in enumerate(self.done)]


@pytest.mark.parametrize("limit,overlap", [(12, 3), (40, 0), (80, 25)])
def test_chunkers_on_random_text(column, limit, overlap):
    rng = random.Random(limit)
    pieces = ["a", "bc", "défg", "hijklmnop", "qrstuvwxyzabcdefghij", ".", "!", " ", " ", " ", "\n\n", "\n", "\u00a0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(120))) for _ in range(150)]
    assert column(lambda c: chunking.char_chunks(c, limit, overlap), texts) == [ByHand(limit).run(t, overlap) for t in texts]
    size = max(2, limit // 10)
    assert column(lambda c: chunking.word_chunks(c, size, 1), texts) == [by_hand_words(t, size, 1) for t in texts]


def test_chunks_hold_every_word_in_order(column):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abc.") for _ in range(rng.randrange(1, 30))) for _ in range(60)) for _ in range(30)]
    for chunks, text in zip(column(lambda c: chunking.char_chunks(c, 50, 0), texts), texts):
        assert " ".join(chunks).split() == text.split()


def test_labels(spark):
    df = spark.createDataFrame([("a.txt", "x" * 5), ("b.txt", "One two. Three four! Five?")], "filename string, text string")
    got = [r["prompt"] for r in chunking.label_prompts(df, 12, 4).orderBy("filename", "chunk_index").collect()]
    assert got == [
        "[a.txt] xxxxx", "[b.txt - Part 1/3] One two. ", "[b.txt - Part 2/3] wo. Three four! ",
        "[b.txt - Part 3/3] ur! Five? ",
    ]
    assert chunking.label_prompts(df.limit(1), bare=True).first()["prompt"] == "xxxxx"


def test_split_prompts(spark):
    df = spark.createDataFrame([(1, " a \n---\n\n---b---c-- "), (2, " --- ")], "id int, text string")
    got = chunking.split_prompts(df).orderBy("id", "prompt_no").collect()
    assert [(r["prompt_no"], r["prompt"]) for r in got] == [(0, "a"), (1, "b"), (2, "c--")]


PAGES = "doc_id bigint, page_no int, text string, tables array<array<array<string>>>, has_images boolean"


def test_document_from_pages(spark):
    pages = spark.createDataFrame(
        [(1, 2, None, None, False), (1, 1, "p1", [[["a", None], ["c", "d"]], []], True)], PAGES
    )
    row = documents.document_from_pages(pages, extract_tables=True).first()
    assert row["text"] == "p1\n\n" + "\nTable 1-1:\na | \nc | d\n\n" + "\n\n"
    assert (row["pages"], row["tables"], row["has_images"]) == (2, 2, True)
    plain = documents.document_from_pages(pages).first()
    assert plain["text"] == "p1\n\n\n\n" and plain["tables"] == 0


def test_document_from_blocks(spark):
    blocks = spark.createDataFrame(
        [
            (1, "table", 1, None, [["a", "b"]]), (1, "paragraph", 2, "second", None), (1, "paragraph", 0, "first", None),
            (1, "paragraph", 3, "  \u00a0", None), (1, "table", 4, None, [["c"], ["d"]]), (2, "image", 0, None, None),
        ],
        "doc_id bigint, kind string, seq int, text string, cells array<array<string>>",
    )
    got = {r["doc_id"]: r for r in documents.document_from_blocks(blocks).collect()}
    assert got[1]["text"] == "first\nsecond\n\nTable 1:\na | b\n\n\nTable 2:\nc\nd\n\n"
    assert (got[1]["paragraphs"], got[1]["tables"], got[1]["has_images"]) == (2, 2, False)
    assert (got[2]["text"], got[2]["paragraphs"], got[2]["has_images"]) == ("", 0, True)


def test_table_text(spark):
    df = spark.createDataFrame([("f", 1, 1, "x"), ("f", 2, 2, 'y "q", z'), ("f", 3, 3, None), ("f", 4, 4, "")], "file string, n int, a bigint, b string")
    row = documents.table_text(df, ["file"], ["n"], ["a", "b"], block_of("n")).first()
    assert row["text"] == 'a,b\n1,x\n2,"y ""q"", z"\n3,\n4,\n'
    assert (row["rows"], row["columns"]) == (4, 2)


def test_archive_members(spark):
    limit = 10 * 1024 * 1024
    rows = [("z", "a.md", limit), ("z", "b.txt", limit + 1), ("z", "c.xlsx", 1), ("z", "d/e.java", 1), ("z", "archive.zip", 1), ("z", "f.PY", 1)]
    df = spark.createDataFrame(rows, "archive string, rel_path string, size bigint")
    got = {r["rel_path"]: r["file_type"] for r in documents.archive_members(df).collect()}
    assert got == {"a.md": "txt", "d/e.java": "txt", "f.PY": "py"}


FILES = "filename string, file_type string, text string"


@pytest.mark.parametrize("block", [None, "number"])
def test_combine_files(spark, small_limits, block):
    rows = [(f"f{i:02d}.txt", "txt", f"text {i}") for i in range(25)]
    df = spark.createDataFrame(rows, FILES).withColumn("number", F.substring("filename", 2, 2).cast("int"))
    given = block_of(block) if block else None
    want = "".join(f"\n\n==== FILE: {n} ====\n\n{t}" for n, _, t in rows)
    for size in (60, 10**6):
        got = documents.combine_files(df, block=given, segment_chars=size).orderBy("segment_no").collect()
        assert "".join(r["text"] for r in got) == want and sum(r["files"] for r in got) == 25
    listed = documents.combined_metadata(df, block=given, segment_items=10).orderBy("segment_no").collect()
    assert [n for r in listed for n in r["files"]] == [r[0] for r in rows]
    assert [len(r["files"]) for r in listed] == [10, 10, 5] and listed[0]["total_files"] == 25


def test_file_summary(spark):
    from inkwell.sources.files import metadata_struct

    rows = [("a.pdf", "pdf", "abc"), ("b.docx", "docx", ""), ("c.py", "py", "x\ny"), ("d.xlsx", "excel", "1")]
    df = spark.createDataFrame(rows, FILES).withColumn(
        "metadata",
        metadata_struct(
            pages=F.when(F.col("file_type") == "pdf", 3), tables=F.when(F.col("file_type") == "docx", 2),
            has_images=F.lit(True), lines=F.when(F.col("file_type") == "py", 2), characters=F.length("text"),
        ),
    )
    text = "".join(r["entry"] for r in documents.file_summary(df).orderBy("number").collect())
    assert text == (
        "Processed 4 files:\n\n"
        "1. a.pdf (PDF)\n   Pages: 3, Tables: 0, Contains Images: True\n   Extracted: 3 characters\n\n"
        "2. b.docx (DOCX)\n   Paragraphs: Unknown, Tables: 2\n   Extracted: 0 characters\n\n"
        "3. c.py (PY)\n   Lines: 2, Characters: 3\n   Extracted: 3 characters\n\n"
        "4. d.xlsx (EXCEL)\n   Extracted: 1 characters\n"
    )
    assert documents.file_summary(df.limit(0)).first()["entry"] == "No files processed."


def test_merge_and_log(spark):
    df = spark.createDataFrame([("d", 2, "c"), ("d", 0, "a"), ("d", 1, None)], "doc string, chunk_index int, content string")
    merged = documents.merge_chunks(df, ["doc"], ["chunk_index"], F.col("content"), block_of("chunk_index"))
    assert merged.first()["text"] == "a\n\nc"
    log = documents.conversation_log(df, ["doc"], ["chunk_index"], F.struct("content"), block_of("chunk_index"))
    assert [e["content"] for e in log.first()["items"]] == ["a", None, "c"]
