"""BPE and token counts against the library itself."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkwell.llm import bpe, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def by_row(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_round_trip_is_the_librarys(request, name):
    docs = request.getfixturevalue(name)
    lib = Tokenizer.from_file(WORDS)
    want = []
    for i, t in by_row(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, lib.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["ids"], r["decoded"]) for r in bpe.round_trip(docs, WORDS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_encode_then_decode(odd):
    encoded = bpe.encode(odd, WORDS)
    both = {(r["doc_id"], r["decoded"]) for r in bpe.decode(encoded, WORDS).collect()}
    assert both == {(r["doc_id"], r["decoded"]) for r in bpe.round_trip(odd, WORDS).collect()}


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, None, -7, 99_999_999])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(df, WORDS).collect()} == {1: "", 2: "", 3: "a</w>"}


def test_empty_tables(none):
    assert bpe.round_trip(none, WORDS).count() == 0
    assert token_counts.count_tokens(none, BYTES).count() == 0


def plain_merges(piece, ranks, end=""):
    """Merge the pair of the lowest rank, leftmost first, until none is left."""
    parts = [*piece[:-1], piece[-1] + end]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 10**9:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_index_with_merges_out_of_order():
    # The rule that makes "abc" late stands after a rule that uses it.
    merges = [("b", "c"), ("a", "bc"), ("abc", "d"), ("a", "b"), ("ab", "c"), ("d", "a"), ("abc", "abc"), ("aa", "a"), ("a", "a")]
    names = sorted({*"abcd", *(x + y for x, y in merges)})
    vocab = {n: i for i, n in enumerate(names)}
    ranks = {m: r for r, m in enumerate(merges)}
    pieces = ["".join("abcd"[(n >> 2 * k) & 3] for k in range(6)) for n in range(4096)] + ["a" * 30, "abcabcabcd"]
    index = bpe.PairIndex(vocab, merges, "")
    for piece, ids in zip(pieces, index.encode(pieces)):
        assert [names[i] for i in memoryview(ids).cast("i")] == plain_merges(piece, ranks), piece


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    codec = bpe.WordCodec(open(WORDS, "rb").read())
    for n in range(5):
        text = " ".join(f"word{n}{k}" for k in range(30))
        assert list(memoryview(codec.encode([text])[0]).cast("i")) == library_ids(WORDS, text)
        assert len(codec.words) <= 30


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_counts_are_the_librarys(request, name):
    docs = request.getfixturevalue(name)
    lib = Tokenizer.from_file(BYTES)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in by_row(docs)]
    got = [tuple(r) for r in token_counts.count_tokens(docs, BYTES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_frequent_units_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, "x common words " + f"rare{i} common") for i in range(400)], "doc_id long, text string")
    found = {r["unit"]: r["n"] for r in token_counts.frequent_units(docs, counters=16).collect()}
    assert found["common"] >= 800 - 400 * 4 / 16 and set(found) >= {"common", "words"}
    limited = token_counts.frequent_units(docs, limit=1).collect()
    assert [r["unit"] for r in limited] == ["common"]


def test_frequent_units_of_many_tokens(spark):
    """A frequent unit of 64 characters has more tokens than a byte can say."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join([chr(0x12000) * 64] * 10), " ".join([chr(0x20000) * 64] * 3), "a " * 9] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, path).collect())
    want = [(i, len(t.encode()), len(library_ids(path, t))) for i, t in enumerate(texts)]
    assert got == want and want[0][2] > 10 * 255


def test_query_digests(spark):
    from inkwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe_round_trip"](spark, sf).limit(40).collect():
        ids = library_ids(WORDS, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    for r in QUERIES["op7_token_counts"](spark, sf).collect():
        assert r["over_limit"] == (r["n_tokens"] > 1024)
