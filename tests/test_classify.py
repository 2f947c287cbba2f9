"""Softmax from stored coefficients, and the slope of the loss."""

import math
import random

import pytest

from corpusloom.operators import classify as clf


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        label = i % 3
        rows.append((i, [rng.gauss(label == k, 0.7) for k in range(4)], label))
    return spark.createDataFrame(rows, "doc_id bigint, vector array<double>, label int")


@pytest.fixture(scope="module")
def model(vectors):
    return clf.train(vectors)


def plain(table, vector):
    z = [c + sum(w * x for w, x in zip(ws, vector)) for _, c, ws in table]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_table_classifies_like_the_model(spark, vectors, model):
    table = clf.coefficients(model, spark)
    by_model = {r.doc_id: r for r in clf.classify(model, vectors).collect()}
    for r in clf.classify_by_table(table, vectors).collect():
        want = by_model[r.doc_id]
        assert r.predicted == want.predicted
        assert abs(r.distance - want.distances[r.predicted]) < 1e-9


def test_slope_against_plain_loops(spark, vectors):
    table = [(0, 0.5, [1.0, 0.0, 2.0, -1.0]), (1, 0.0, [0.0, 3.0, 0.0, 0.1]), (2, -1.0, [0.2] * 4)]
    stored = spark.createDataFrame(table, "class int, intercept double, weights array<double>")
    rows = [(r.vector, r.label) for r in vectors.collect()]
    want = {}
    for k, _, ws in table:
        for i in range(-1, 4):
            total = sum(
                (plain(table, v)[k] - (label == k)) * (1 if i < 0 else v[i]) for v, label in rows
            )
            want[k, i] = total / len(rows) + (0.01 * ws[i] if i >= 0 else 0)
    got = {(r["class"], r.i): r.gradient for r in clf.loss_gradient(stored, vectors, 0.01).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_training_ends_at_the_optimum(spark, vectors, model):
    slopes = clf.loss_gradient(clf.coefficients(model, spark), vectors).collect()
    assert max(abs(r.gradient) for r in slopes) < 1e-3


def test_large_logits_do_not_overflow(spark):
    table = [(0, 0.0, [1e5]), (1, 0.0, [-1e5])]
    stored = spark.createDataFrame(table, "class int, intercept double, weights array<double>")
    rows = spark.createDataFrame([(1, [1.0]), (2, [-1.0]), (3, [0.0])], "doc_id bigint, vector array<double>")
    got = {r.doc_id: (r.predicted, r.distance) for r in clf.classify_by_table(stored, rows).collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.0), 3: (0, 0.5)}
