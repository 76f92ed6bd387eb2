"""The ordinal fit against finite differences and other points, its calibration, and grades from two labels."""

import random

import numpy as np
from pyspark.sql import functions as F

from pulsefield.llm import toxicity
from tests.llm.helpers import frame, prose


def sample(seed, n, thresholds, weights):
    """Rows of features and grades drawn from the model itself."""
    rng = np.random.default_rng(seed)
    rows = [np.flatnonzero(rng.random(len(weights)) < 0.3) for _ in range(n)]
    x = np.array([weights[r].sum() for r in rows])
    above = 1 / (1 + np.exp(np.array(thresholds)[None, :] - x[:, None]))
    return rows, (rng.random(n)[:, None] < above).sum(axis=1)


def test_gradient_equals_finite_differences():
    rows, grades = sample(1, 200, [0.0, 1.0, 2.5], np.linspace(-1, 2, 8))
    target = toxicity.Likelihood(rows, grades, 8, penalty=0.01)
    at = np.random.default_rng(2).normal(size=11)
    gradient = target(at)[1]
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-5
        assert abs((target(at + step)[0] - target(at - step)[0]) / 2e-5 - gradient[i]) < 1e-6


def test_fit_is_the_optimum():
    # Plain gradient descent with halving steps from another start reaches no lower value.
    rows, grades = sample(3, 400, [-0.5, 0.8], np.linspace(-1, 1.5, 6))
    target = toxicity.Likelihood(rows, grades, 6, penalty=0.01)
    at, rate = np.full(8, 0.3), 1.0
    for _ in range(3000):
        value, g = target(at)
        while target(at - rate * g)[0] > value and rate > 1e-9:
            rate /= 2
        at, rate = at - rate * g, rate * 1.5
    w, thresholds = toxicity.fit_cumulative_link(rows, grades, 6, penalty=0.01)
    assert np.allclose(w, at[:6], atol=0.02) and np.allclose(thresholds, target.thresholds(at), atol=0.02)


def test_thresholds_and_calibration_on_held_out_rows():
    weights = np.linspace(-1, 2, 12)
    rows, grades = sample(5, 6000, [0.5, 1.5, 3.0], weights)
    w, thresholds = toxicity.fit_cumulative_link(rows[:3000], grades[:3000], 12)
    assert list(thresholds) == sorted(thresholds) and np.allclose(thresholds, [0.5, 1.5, 3.0], atol=0.35) and np.allclose(w, weights, atol=0.35)
    model = toxicity.OrdinalModel({}, thresholds)
    above = model.above(np.array([w[r].sum() for r in rows[3000:]]))
    for k in range(3):
        for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1)):
            mine = (above[:, k] >= low) & (above[:, k] < high)
            if mine.sum() > 150:
                assert abs((grades[3000:][mine] > k).mean() - above[mine, k].mean()) < 0.06


def test_two_labels_make_three_grades(spark):
    rng = random.Random(8)
    kinds = [(i, rng.choice([0, 1]), rng.choice([1, 1, 0, None])) for i in range(400)]
    docs = frame(spark, [(i, prose(rng, 30, 200) + " insult" * toxic + (" junk rubbish" if good == 0 else ""), "a") for i, toxic, good in kinds])
    labels = spark.createDataFrame(kinds, "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, good_col="quality")
    assert len(model.thresholds) == 2
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).collect()}
    assert sum((got[i].toxicity >= 0.5) == (toxic == 1) for i, toxic, _ in kinds) > 390
    grades = [0 if not toxic else 2 if good == 0 else 1 for _, toxic, good in kinds]
    assert abs(np.mean([got[i].expected_severity for i, *_ in kinds]) - np.mean(grades)) < 0.05
    mean = lambda grade: np.mean([got[i].expected_severity for (i, *_), g in zip(kinds, grades, strict=True) if g == grade])
    assert mean(0) < mean(1) <= mean(2)
    assert len(toxicity.train(docs, labels).thresholds) == 1
