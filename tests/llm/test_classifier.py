import random

import numpy as np
import pytest
from conftest_llm import rows
from pyspark.sql import functions as F

from loomslice.llm import classifier, queries

LABELS = "doc_id long, quality int, toxic int"


def graded(seed, n):
    """Texts of three grades by their words: (doc_id, text), labels, grade."""
    rng = random.Random(seed)
    common, good, poor, bad = ([f"{k}{chr(97 + i % 26)}{i}" for i in range(m)] for k, m in (("com", 300), ("fine", 60), ("junk", 60), ("vile", 60)))
    docs, labels, grades = [], [], []
    for i in range(n):
        g = rng.choices((0, 1, 2), (3, 1, 6))[0]
        text = rng.choices(common, k=60) + rng.choices((poor, bad, good)[g], k=12)
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(g > 0), int(g == 1)))
        grades.append(g)
    return docs, labels, grades


@pytest.fixture(scope="module")
def model(spark):
    docs, labels, _ = graded(1, 1200)
    return classifier.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))


def test_held_out_accuracy(spark, model):
    docs, _, grades = graded(2, 600)
    out = {r["doc_id"]: r for r in classifier.rate(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    right = sum((out[i]["kept"]) == (g == 2) for i, g in enumerate(grades))
    assert right >= 0.95 * len(grades)
    mean = [np.mean([out[i]["expected_grade"] for i, g in enumerate(grades) if g == k]) for k in range(3)]
    assert mean[0] < mean[2] and mean[1] < mean[2]
    assert all(0 <= r["p_top"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out.values())


def test_thresholds_are_ordered_and_shared(model):
    assert (np.diff(model.thresholds) > 0).all() and model.weights.shape == (classifier.DIM,)
    s = np.linspace(-5, 5, 50)
    assert (model.tail(s, 1) >= model.tail(s, 2)).all() and (np.diff(model.expected(s)) > 0).all()
    assert np.allclose(model.expected(s), model.tail(s, 1) + model.tail(s, 2))


def test_gradient_is_numeric():
    """The fit's step goes where the likelihood, computed apart, grows: it ends near a maximum."""
    rng = np.random.default_rng(0)
    rows_ = []
    for _ in range(300):
        x = rng.normal(size=3)
        g = int(np.digitize(x @ [1.5, -1, 0] + rng.logistic(), [-1, 1]))
        rows_.append((np.array([5, 6, 7]), x, g))
    m = classifier.fit(rows_, rounds=1500, rate=0.02, decay=0.0)
    y = np.array([g for *_, g in rows_])
    n = np.bincount(y, minlength=3)
    weight = np.sqrt(1 / n[y])

    def loss(w, theta):
        s = np.array([x @ w for _, x, _ in rows_])
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        f = lambda v: 1 / (1 + np.exp(-v))
        return -(weight * np.log(f(cut[y + 1] - s) - f(cut[y] - s))).sum() / weight.sum()

    w, at = m.weights[[5, 6, 7]], loss(m.weights[[5, 6, 7]], m.thresholds)
    for k in range(3):
        for d in (0.05, -0.05):
            assert loss(w + d * np.eye(3)[k], m.thresholds) > at - 1e-6
    for k in range(2):
        for d in (0.05, -0.05):
            assert loss(w, m.thresholds + d * np.eye(2)[k]) > at - 1e-6


def test_scores_are_features_times_weights(model):
    rng = np.random.default_rng(1)
    m = classifier.OrdinalModel(rng.normal(size=classifier.DIM), np.array([0.0, 1.0]))
    score = classifier._scorer(m)
    for text in (b"", b" ", b"One two. two, TWO!", "Straße Ωmega \U0001f600 été".encode(), b"a" * 500 + b" 1234-5678", b"\xff\xfe bad bytes", " wide".encode()):
        index, value = classifier.features(text, {})
        assert score(text) == pytest.approx(float(m.weights[index] @ np.array(value)))


def test_query_rates_all(spark, sf, docs):
    out = queries.op7_ordinal_quality(spark, sf)
    assert rows(out.select("doc_id")) == rows(docs.select("doc_id"))
    assert rows(out) == rows(queries.op7_ordinal_quality(spark, sf))


def test_sample_is_bounded(spark):
    docs, labels, _ = graded(3, 400)
    one = classifier.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), sample=100)
    two = classifier.learn(spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(7), spark.createDataFrame(labels[::-1], LABELS), sample=100)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.thresholds, two.thresholds)


def test_odd_rows(spark, odd, clashing, none, model):
    out = classifier.rate(odd, model)
    assert rows(out.select("doc_id")) == rows(odd.select("doc_id")) and classifier.rate(none, model).count() == 0
    assert rows(classifier.rate(clashing, model)) == rows(out)
    kept = classifier.keep_top(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == out.where("kept").count()
    assert classifier.keep_top(none, model).count() == 0


def test_odd_labels(spark, odd, none):
    """Null, doubled, conflicting and stray labels, and none at all: then everything gets the top grade."""
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (4, 1, None), (7, 1, 0), (7, 0, 0), (999, 1, 1), (10, 1, 0)], LABELS)
    more = labels.select("*", F.lit(1).alias("grade"), F.lit(2).alias("text"), F.lit(3).alias("DOC_ID"))
    assert classifier.rate(odd, classifier.learn(odd, labels)).count() == odd.count()
    assert classifier.rate(odd, classifier.learn(odd, more)).count() == odd.count()
    for data, empty in ((odd, labels.limit(0)), (none, labels)):
        assert classifier.rate(odd, classifier.learn(data, empty)).where("not kept").count() == 0
