"""Co-training: agreement with labels it has not seen, calibration, edges."""

from __future__ import annotations

import numpy as np

from brambling.llm import cotraining as c


def test_held_out_labels(spark):
    """Fitted on two thirds of the labels of a larger table, judged on the rest."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    model = c.train(docs, labels.filter(seen))
    judged = c.score(docs, model).join(labels.filter(~seen), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert right >= 0.9 * len(judged)
    good = [r for r in judged if r["quality"] == 1]
    assert sum(not r["kept"] for r in good) <= 0.03 * len(good)
    assert all(0 <= r[k] <= 1 for r in judged for k in ("score", "content_score", "metadata_score"))
    kept = c.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == c.score(docs, model).filter("kept").count()


def test_views_help_each_other():
    """Labels are few; the pool's pseudo-labels reach words that no labelled row has."""
    r = np.random.RandomState(2)

    def vector(size, at):
        at = np.unique(np.array(at))
        return at, np.full(len(at), 1 / np.sqrt(len(at)))

    def row(y):
        return vector(50, 25 * y + r.randint(0, 25, 4)), vector(20, 10 * y + r.randint(0, 10, 3))

    labelled = [(row(i % 2), i % 2) for i in range(40)]
    model = c.co_train([(v, y) for v, y in sorted(labelled, key=lambda x: x[0][0][0][0])], [row(i % 2) for i in range(400)])
    fresh = [(row(i % 2), i % 2) for i in range(200)]
    assert np.mean([(model.scores(v)[0] > 0.5) == bool(y) for v, y in fresh]) >= 0.95


def test_platt_orders_and_calibrates():
    r = np.random.RandomState(0)
    x = r.randn(4000) * 2
    y = (r.rand(4000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(int)
    slope, intercept = c.platt(x[:, None], y)
    assert abs(slope - 1.5) < 0.2 and abs(intercept + 0.5) < 0.2


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = c.train(edges, known)
        got = c.score(edges, model)
        assert got.count() == edges.count() and got.filter("score is null or kept is null").count() == 0
        assert c.keep_good(edges, model).columns == edges.columns
        assert c.score(nothing, model).count() == 0
        assert c.score(edges.select("doc_id", "text"), model).count() == edges.count()
    assert c.train(nothing, labels) is None
    assert c.score(edges, None).filter("not kept or score < 1").count() == 0


def test_threshold_weighs_both_classes():
    bad, good = np.linspace(0.01, 0.2, 50), np.linspace(0.6, 0.99, 150)
    scores, y = np.concatenate([bad, good]), np.repeat([0, 1], [50, 150])
    assert 0.2 < c.least_cost_threshold(scores, y) <= 0.5
    # A good label on one row that scores near 0 doesn't move the threshold there.
    noisy = c.least_cost_threshold(np.append(scores, 0.001), np.append(y, 1))
    assert 0.2 < noisy <= 0.5
    # Few bad documents aren't worth a good one.
    assert c.least_cost_threshold(np.array([0.1, 0.2, 0.3, 0.9]), np.array([1, 0, 0, 1])) < 0.1
    assert c.least_cost_threshold(np.array([0.5, 0.5]), np.array([0, 1])) <= 0.5
    assert c.least_cost_threshold(np.array([0.9, 0.8]), np.array([1, 1])) <= 0.5
