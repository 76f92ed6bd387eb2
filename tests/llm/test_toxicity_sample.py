"""The labelled sample: one row an id, and samples of few rows."""

import random

from pyspark.sql import functions as F

from pulsefield.llm import toxicity
from tests.llm.helpers import frame, prose


def found(spark, docs, labels):
    rows = frame(spark, docs)
    model = toxicity.train(rows, spark.createDataFrame(labels, "doc_id long, toxic int"))
    return model, {r.text: r.s.toxicity >= 0.5 for r in rows.select("text", toxicity.severity(model, F.col("text")).alias("s")).collect()}


def test_rows_that_repeat_an_id_count_once(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, 30, 200) + (" insult" * 3 if i % 4 == 0 else ""), "a") for i in range(120)]
    labels = [(i, int(i % 4 == 0)) for i in range(80)]
    once = found(spark, docs, labels)
    again = found(spark, docs + [docs[1]] * 300, labels + [labels[1]] * 300)
    assert again[0].weights == once[0].weights and list(again[0].thresholds) == list(once[0].thresholds)


def test_a_dozen_labels_are_learnt_from(spark):
    rng = random.Random(7)
    docs = [(i, prose(rng, 30, 2000) + (" insult slur" * 3 if i % 3 == 0 else ""), "a") for i in range(60)]
    _, toxic = found(spark, docs, [(i, int(i % 3 == 0)) for i in range(14)])
    assert all(toxic[t] == (i % 3 == 0) for i, t, _ in docs)
