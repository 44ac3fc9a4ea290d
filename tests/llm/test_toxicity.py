"""Multiple-instance learning: held-out accuracy, sentences found, odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import toxicity
from inkwell.llm.queries import QUERIES, not_held_out

INSULTS = ["blorf", "snarg", "vexling"]


def corpus(n, seed=5):
    """Made-up prose; one sentence of the documents labelled 1 holds an insult. Long documents too."""
    random.seed(seed)
    words = ["".join(random.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(6)) for _ in range(150)]
    docs, labels, where = [], [], {}
    for i in range(n):
        cut = [[random.choice(words) for _ in range(random.randint(3, 9))] for _ in range(random.choice([2, 5, 60]))]
        toxic = int(random.random() < 0.2)
        if toxic:
            where[i] = random.randrange(len(cut))
            cut[where[i]].insert(1, random.choice(INSULTS).capitalize() + random.choice(["", "s", "ed"]))
        docs.append((i, ". ".join(map(" ".join, cut)) + ".", 9.0))
        labels.append((i, toxic))
    return docs, labels, where


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels, where = corpus(1500)
    docs = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, where, toxicity.train(docs, labels, not_held_out())


def test_held_out_documents_and_sentences(learnt):
    docs, labels, where, model = learnt
    found = toxicity.score(docs, model).join(labels, "doc_id").where(~not_held_out()).collect()
    assert len(found) > 250
    assert np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.97
    hits = [r["sentence"] == where[r["doc_id"]] for r in found if r["toxic"] and r["predicted"]]
    assert np.mean(hits) > 0.97
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == bool(r["predicted"]) for r in found)


def test_held_out_labels_are_not_learnt(learnt, spark):
    docs, labels, _, model = learnt
    turned = labels.withColumn("toxic", F.when(not_held_out(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.train(docs, turned, not_held_out()) == model


def test_keeping_is_scoring(learnt):
    docs, _, _, model = learnt
    kept = toxicity.keep_harmless(docs, model)
    assert kept.columns == docs.columns
    scores = toxicity.score(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores.where("predicted = 0").collect()}


def test_sample_is_bounded(learnt):
    docs, labels, _, _ = learnt
    rows = toxicity.training_rows(docs, labels, not_held_out(), "doc_id", "text", "toxic", 100)
    assert rows.count() == 100


def test_odd_texts_and_tables(odd, none, learnt, spark):
    _, labels, _, model = learnt
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r["doc_id"] in (0, 1, 2)]
    assert all(r["score"] == pytest.approx(model["leak"]) and r["sentence"] == -1 for r in empty)
    assert toxicity.score(none, model).count() == 0
    for poor in (labels.where("doc_id < 0"), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.train(odd, poor, not_held_out())
        assert not model["words"] and toxicity.score(odd, model).where("predicted = 1").count() == 0
    repeated = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (7, None)], labels.schema))
    toxicity.train(odd, repeated, not_held_out())


def test_gradient_lowers_the_loss():
    toxic = [{"y": 1, "n": 3, "at": [0, 1], "f": [0, 1]}] * 20
    clean = [{"y": 0, "n": 4, "at": [0], "f": [1]}, {"y": 0, "n": 400, "at": [], "f": []}] * 90
    model = toxicity.fit(toxic + clean, 2)
    assert model["weights"][0] > 4 and model["weights"][1] < 1 and model["leak"] < 0.05


def test_common_labels_are_explained_by_sentences():
    bags = [{"y": 1, "n": 3, "at": [0, 1], "f": [0, 1]}, {"y": 0, "n": 4, "at": [0], "f": [1]}, {"y": 0, "n": 400, "at": [], "f": []}] * 20
    model = toxicity.fit(bags, 2)
    assert model["weights"][0] > 4 and model["weights"][1] < 1 and model["leak"] <= 0.05


@pytest.mark.parametrize("toxic, n", [(12, 60), (20, 60), (300, 600)])
def test_common_labels_are_recalled(spark, toxic, n):
    texts = [f"plain words stand here. {'blorf comes' if i < toxic else 'nothing comes'}. more words." for i in range(n)]
    docs = spark.createDataFrame([*enumerate(texts), (n, ""), (n + 1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(n)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    found = toxicity.score(docs, model).where("predicted = 1").collect()
    assert {r["doc_id"] for r in found} == set(range(toxic))
    assert toxicity.keep_harmless(docs, model).count() == n + 2 - toxic


def test_leak_is_bounded_without_features(spark):
    docs = spark.createDataFrame([(i, "all words alike") for i in range(40)], "doc_id long, text string")
    for share in (0.5, 1.0):
        labels = spark.createDataFrame([(i, int(i < 40 * share)) for i in range(40)], "doc_id long, toxic int")
        model = toxicity.train(docs, labels, F.lit(True))
        assert not model["words"] and toxicity.keep_harmless(docs, model).count() == 40


def test_query(spark):
    rows = QUERIES["op4_noisy_or_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and 200 < sum(r["held_out"] for r in rows) < 300
    wrong = [r for r in held if r["predicted"] and not labels[r["doc_id"]]]
    assert len(wrong) <= 0.02 * len(held)
