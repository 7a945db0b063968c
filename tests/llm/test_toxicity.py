"""Toxicity: held-out accuracy, the places found, and texts that carry nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import toxicity as X
from terrapanel.llm.common import text_or_empty


@pytest.fixture(scope="module")
def corpus():
    """Clean sentences, with one foul sentence in every fourth document; nobody labels sentences."""
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in "ba co di fu ge ho".split() for b in "lam nit ron sek tur".split()]
    foul = ["grumbag", "snotter", "vilewort"]
    rows, spots = [], {}
    for i in range(500):
        own = [" ".join(rnd.choice(words) for _ in range(8)) for _ in range(rnd.randint(3, 30))]
        if i % 4 == 0:
            at = rnd.randrange(len(own))
            own[at] = own[at] + " " + rnd.choice(foul) + " " + rnd.choice(words)
            spots[i] = own[at]
        rows.append((i, ". ".join(own) + "."))
    return rows, spots


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    labels = docs.filter("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    return X.train(docs, labels)


def test_held_out_documents(spark, corpus, model):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string").filter("doc_id % 5 = 0")
    got = docs.select("doc_id", X.score_column(model, text_or_empty("text")).alias("t")).select("doc_id", "t.*").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got)


def test_offending_sentences_are_located(spark, corpus, model):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string").filter("doc_id % 20 = 0")
    text = dict(corpus[0])
    got = X.offending_sentences(docs, model).collect()
    assert {(r.doc_id, text[r.doc_id][r.start:r.end]) for r in got} == {(i, s) for i, s in corpus[1].items() if i % 20 == 0}


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(3)
    sizes = [[2, 1], [1], [], [3], [1, 1, 1]] * 20
    features = [rng.integers(0, 6, sum(s)).tolist() for s in sizes]
    toxic = np.array([int(0 in f) for f in features])
    w, b = X.fit_noisy_or(toxic, np.full(len(sizes), 4.0), features, sizes, 6)
    assert w[0] > w[1:].max() + 2 and b < -1


def test_noisy_or():
    assert X.noisy_or(np.array([])) == 0.0 and X.noisy_or(np.array([0.5, 0.5])) == pytest.approx(0.75) and X.noisy_or(np.array([1.0])) <= 1.0


def test_hard_rows(hard, model):
    got = X.toxicity(hard, model)
    assert got.columns == [*hard.columns, "toxicity"] and got.count() == hard.count()
    assert all(0 <= r.toxicity.score <= 1 for r in got.collect())
    assert X.offending_sentences(hard, model).count() == 0


def test_labels_with_gaps_and_conflicts(hard, spark, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (5, 0), (99, 1)], "doc_id long, toxic int")
    assert isinstance(X.train(hard, labels), X.Model)
    none = X.train(hard, labels.filter("1 = 0"))
    assert none.weights == {} and X.train(empty, labels).weights == {}
    assert X.toxicity(empty, none).count() == 0


def test_words_outside_the_sample_and_rare_labels_count(spark, corpus):
    """Twelve toxic documents of 387 and a sample of six, which cannot hold each of four words three times."""
    clean = [(i, t, 0) for i, t in corpus[0] if i not in corpus[1]]
    rare = [(1000 + i, f"babble {w}. fulam", 1) for i, w in enumerate(["onefoul", "twofoul", "redfoul", "oddfoul"] * 3)]
    docs = spark.createDataFrame(clean + rare, "doc_id long, text string, toxic int")
    got = X.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), max_train=6)
    assert all(got.weights.get(f"={w}", 0) > 0 for w in ("onefoul", "twofoul", "redfoul", "oddfoul"))
