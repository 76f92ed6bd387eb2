"""Severity grades by cumulative-link ordinal regression over sparse text features.

Features of a text are present or not: its words, and the openings of its words of four to six
letters (inflected forms share those). The vocabulary is the features most associated with labelled severity.

Model: P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector shared by all the rising thresholds.
It gives the expected severity, the sum over grades of grade times probability, and
P(grade >= 1), by which a text is called toxic.

Grades come from labels, never from the features. A numeric label is used as it is; toxic yes or no gives two grades and one threshold. A
second label, if named, ranks the toxic rows: severity 1 is toxic in a text labelled good (or not labelled), severity 2 toxic in one labelled poor.

Training uses a bounded sample: at most ``sample_rows`` labelled rows, taken by a hash of the id, and at most
``vocabulary`` features. Only feature counts and feature numbers of the sample reach the driver. Scoring covers every
row and whole texts; the model it ships has at most ``vocabulary`` weights.

Edge cases: a null or empty text has no features and gets the severity of that. With no labelled rows, or only one grade, every
text has that grade (0 if none). Grades are taken in their order; one that no label has is no grade. Null labels and labels of unknown documents are ignored; a document
labelled more than once has its highest grade. Rows with equal texts score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release, table

WORDS = re.compile(r"\w+")
OPENINGS = (4, 5, 6)


def features(text: str | None) -> set[str]:
    """The words of a text, and openings of longer words marked by a caret."""
    found = set(WORDS.findall((text or "").lower()))
    out = set(found)
    for n in OPENINGS:
        out |= {"^" + w[:n] for w in found if len(w) > n}
    return out


@dataclass
class OrdinalModel:
    """Weights by feature and the rising thresholds between grades."""

    weights: dict[str, float]
    thresholds: np.ndarray
    lowest: int = 0

    def margin(self, text: str | None) -> float:
        """w.x of a text, summed in an order that doesn't depend on hashing."""
        if not self.weights:
            return 0.0
        found = set(WORDS.findall((text or "").lower()))
        hits = found & self.weights.keys()
        for n in OPENINGS:
            hits |= {"^" + p for p in {w[:n] for w in found if len(w) > n}} & self.weights.keys()
        return sum(self.weights[f] for f in sorted(hits))

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a row per text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -60, 60)))

    def score(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grade, expected severity and the probability of being above the lowest grade."""
        above = self.above(margins)
        expected = self.lowest + above.sum(axis=1)
        grade = self.lowest + (above >= 0.5).sum(axis=1)
        return grade, expected, above[:, 0] if above.shape[1] else np.zeros(len(margins))


class Likelihood:
    """The penalised mean negative log-likelihood of grades 0..K under shared weights and rising thresholds.

    Parameters are the weights, the first threshold and the logarithms of the gaps to the next.
    """

    def __init__(self, rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 2e-5):
        self.grades, self.n_features, self.penalty, self.k = grades, n_features, penalty, int(grades.max())
        self.owner, self.columns = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)

    def start(self) -> np.ndarray:
        share = (self.grades == 0).mean()
        return np.concatenate([np.zeros(self.n_features), [np.log(share / max(1e-9, 1 - share) + 1e-9)], np.zeros(self.k - 1)])

    def thresholds(self, parameters: np.ndarray) -> np.ndarray:
        free = parameters[self.n_features :]
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    def __call__(self, parameters: np.ndarray) -> tuple[float, np.ndarray]:
        """The value and its gradient."""
        w, grades, n = parameters[: self.n_features], self.grades, len(self.grades)
        gaps, edges = np.exp(parameters[self.n_features + 1 :]), np.concatenate([[-np.inf], self.thresholds(parameters), [np.inf]])
        x = np.bincount(self.owner, w[self.columns], n)
        # Likelihood of a grade: the difference of the two sigmoids around it.
        high, low = (1 / (1 + np.exp(-np.clip(edges[grades + d] - x, -60, 60))) for d in (1, 0))
        p = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / p, low * (1 - low) / p
        of_threshold = np.array([(down[grades == j + 1].sum() - up[grades == j].sum()) / n for j in range(self.k)])
        of_free = np.array([of_threshold.sum(), *(of_threshold[j:].sum() * gaps[j - 1] for j in range(1, self.k))])
        of_w = np.bincount(self.columns, ((up - down) / n)[self.owner], self.n_features) + self.penalty * w
        return -np.log(p).mean() + self.penalty / 2 * float(w @ w), np.concatenate([of_w, of_free])


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 2e-5, steps: int = 500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and thresholds for grades 0..K by penalised maximum likelihood (Adam on all rows, the rate falling at the end)."""
    target = Likelihood(rows, grades, n_features, penalty)
    at = target.start()
    m, v = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, steps + 1):
        g = target(at)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        slower = min(1.0, 4 * (steps - step + 1) / steps)
        at = at - rate * slower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return at[:n_features], target.thresholds(at)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", good_col: str | None = None, sample_rows: int = 20_000, vocabulary: int = 20_000, least_rows: int = 5, least_chi: float = 15.0) -> OrdinalModel:
    """Fit the model on a sample of at most sample_rows labelled documents.

    good_col: a label, 0 if the text is poor, by which toxic rows (label 1) are of severity 2 or 1.
    Each id counts once: with its highest grade if labels differ, with the text of least hash if rows repeat it.
    A feature must be in least_rows rows and have a chi-squared of least_chi; samples too small for that ask for less.
    """
    grade = F.col(label_col).cast("int")
    if good_col is not None:
        grade = F.when((grade == 1) & (F.col(good_col).cast("int") == 0), 2).otherwise(grade)
    known = labels.select(F.col(id_col).alias("id"), grade.alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # narrow rows, bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "features": [sorted(features(t)) for t in batch["text"]]})

    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("first"))
    held = materialize(one.select("y", F.col("first.text").alias("text")).mapInPandas(extract, "y int, features array<string>"), "labelled")
    totals = {r.y: r["count"] for r in held.groupBy("y").count().collect()}
    lowest, n = min(totals, default=0), sum(totals.values())
    if len(totals) < 2:
        release(held)
        return OrdinalModel({}, np.zeros(0), lowest)
    up = {cut: sum(c for y, c in totals.items() if y > cut) for cut in sorted(totals)[:-1]}
    marked = held.select("y", F.explode("features").alias("f"))
    counts = marked.groupBy("f").agg(F.count("*").alias("n"), *[F.sum((F.col("y") > cut).cast("int")).alias(f"up{i}") for i, cut in enumerate(up)])

    def chi(i: int, above: int) -> Column:
        """Chi-squared of a feature against being above a threshold."""
        expected = F.col("n") * (above / n)
        gap = F.col(f"up{i}") - expected
        return gap * gap / (expected * F.lit(1 - above / n) * (1 - F.col("n") / (n + 1)))

    # Chi-squared is at most about n; a cut of 15 holds from 60 rows on.
    most = max(min(above, n - above) for above in up.values())
    enough, cut = min(least_rows, (most + 1) // 2), min(least_chi, n / 4)
    strongest = F.array_max(F.array(*[chi(i, above) for i, above in enumerate(up.values())]))
    best = counts.where(F.col("n") >= enough).select("f", strongest.alias("chi")).where(F.col("chi") > cut).orderBy(F.desc("chi"), "f").limit(vocabulary).collect()
    if not best:
        release(held)
        return OrdinalModel({}, np.array([np.log((n - above) / above) for above in up.values()]), lowest)
    place = {r.f: i for i, r in enumerate(best)}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(place[f] for f in row if f in place) for row in batch["features"]]
            yield pd.DataFrame({"y": batch["y"], "columns": found})

    sample = held.mapInPandas(number, "y int, columns array<int>").toPandas()
    release(held)
    sample["key"] = [tuple(c) for c in sample["columns"]]
    sample = sample.sort_values(["y", "key"], kind="stable")  # sums don't depend on the order of arrival
    rows = [np.asarray(c, np.int64) for c in sample["columns"]]
    places = {grade: i for i, grade in enumerate(sorted(totals))}
    y = sample["y"].map(places).to_numpy()
    w, thresholds = fit_cumulative_link(rows, y, len(best))
    return OrdinalModel({f: round(float(w[i]), 6) for f, i in place.items() if abs(w[i]) > 1e-4}, np.round(thresholds, 6), lowest)


def severity(model: OrdinalModel, text: Column) -> Column:
    """A struct (grade, expected_severity, toxicity) of a text column."""

    @F.pandas_udf("grade int, expected_severity double, toxicity double")
    def score(texts: pd.Series) -> pd.DataFrame:
        grade, expected, above = model.score(np.array([model.margin(t if isinstance(t, str) else None) for t in texts], float))
        return pd.DataFrame({"grade": grade, "expected_severity": expected.round(6), "toxicity": above.round(6)})

    return score(text.cast("string"))


def score_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with a column ``severity`` (replaced if there is one)."""
    return docs.withColumn("severity", severity(model, F.col(text_col)))


def op2_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity.*").withColumn("toxic", (F.col("toxicity") >= 0.5).cast("int"))
