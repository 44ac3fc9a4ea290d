"""The pipeline's stages against plain versions, and its registration."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from inkwell.llm import quality, secrets, toxicity
from inkwell.llm.queries import not_held_out
from inkwell.session import written
from tests.llm.test_jaccard import plain_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_in_a_row(spark, documents, labels):
    docs = documents
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = written(stage(spark, docs, SF), "stage")
        if n < 4:
            assert got.columns == documents.columns and got.dtypes == documents.dtypes
        before = docs.collect()
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
            assert rows(got) == sorted((tuple(r) for r in before if r["doc_id"] in kept), key=repr)
        elif name == "toxicity":
            model = toxicity.train(docs, labels, not_held_out())
            kept = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
            assert rows(got) == sorted((tuple(r) for r in before if r["doc_id"] in kept), key=repr)
        elif name == "n-gram Jaccard join":
            linked = plain_join([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in got.collect()} == {c for _, _, c in linked}
        elif name == "secret scans":
            want = []
            for r in before:
                text = secrets.blank(r["text"], "[SECRET]", secrets.REACH)
                want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
            assert rows(got) == sorted(want, key=repr)
            assert any("[SECRET]" in r[1] for r in want)
        else:
            assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in before}
        docs = got


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 50 and "bucket_length" in got.columns
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_duplicates_with_nulls_and_repeats(spark):
    texts = [(1, "a b c d e f g"), (2, "A b c d e f g"), (None, "x y z u v w q"), (None, None), (7, None), (7, None), (5, ""), (9, "a b c d e f g"),
             (9, "a b c d e f g"), (None, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each(spark, docs, SF)
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    # The group's smallest id is NULL, which stands first.
    assert kept == sorted([(None, "a b c d e f g"), (None, "x y z u v w q"), (None, None), (7, None), (5, "")], key=repr)


def test_empty_table_goes_through(spark, documents):
    docs = documents.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_every_operator_has_a_query_on_whole_tables():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(contract.oracle_sql()) <= set(contract.queries())
