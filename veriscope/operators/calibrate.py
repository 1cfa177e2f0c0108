"""Logistic heads fitted on aggregated sums: no row leaves its task."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.operators.evaluate import best_threshold, grid, measures, resample_weights, scan
from veriscope.operators.features import logistic
from veriscope.plans.shared import Workspace, read_text, write_text

PREDICTORS = ("exact", "fuzzy", "bm25_recall", "semantic", "voters", "lexical_cosupport", "entity_absent", "nli_entail", "nli_contra")
# Mean and standard deviation of the prior of the intercept and of each predictor.
PRIOR = {
    "Intercept": (-3.0, 1.0), "exact": (6.0, 2.0), "fuzzy": (2.0, 2.0), "bm25_recall": (2.5, 2.0), "semantic": (4.5, 2.0), "voters": (1.5, 1.5),
    "lexical_cosupport": (2.0, 1.5), "entity_absent": (-3.0, 1.5), "nli_entail": (5.0, 2.0), "nli_contra": (-5.0, 2.0),
}


# Stylised cases that say what the prior means. Each stands four times.
ANCHOR_COLUMNS = ("grounded", "exact", "fuzzy", "bm25_recall", "semantic", "voters", "lexical_cosupport", "entity_absent")
ANCHORS = (
    (1, 1, 0.95, 0.8, 0.6, 0.75, 1, 0), (1, 0, 0.9, 0.7, 0.5, 0.5, 1, 0), (1, 0, 0, 0, 0.85, 0.25, 0, 0), (1, 0, 0, 0, 0.78, 0.25, 0, 0),
    (0, 0, 0, 0, 0.18, 0.25, 0, 0), (0, 0, 0, 0, 0.05, 0, 0, 0), (0, 0, 0, 0, 0.3, 0.25, 0, 1),
)


@dataclass
class Head:
    """A fitted logistic head: means and standard deviations of the coefficients, and a threshold."""

    mean: dict[str, float]
    sd: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def probability(self) -> Column:
        return logistic(self.mean.get("Intercept", 0.0), {k: v for k, v in self.mean.items() if k != "Intercept"})

    def save(self, path: str) -> None:
        write_text(path, json.dumps({"engine": "calibrated", "threshold": self.threshold, "weights": self.mean, "sd": self.sd}, indent=1))

    @staticmethod
    def load(path: str) -> Head:
        d = json.loads(read_text(path))
        return Head(d["weights"], d.get("sd", {}), d.get("threshold", 0.5))


def varying(df: DataFrame, features: list[str]) -> list[str]:
    """Features with more than one value."""
    row = df.agg(*[(F.max(f) > F.min(f)).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def fit(df: DataFrame, features: list[str], label: str, prior: dict[str, tuple[float, float]] | None = None, weight: str | None = None, ridge: float = 1.0, rounds: int = 25) -> Head:
    """Maximum a posteriori logistic fit by Newton steps, with the curvature as its uncertainty.

    Each step sums the weighted products of the features (a square of a few dozen numbers) over all rows. Without a
    prior the coefficients, not the intercept, are drawn to 0 with strength ``ridge``.
    """
    names = ["Intercept", *features]
    d = len(names)
    x = [F.lit(1.0)] + [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    mu = np.array([(prior or {}).get(n, (0.0, 1.0))[0] for n in names])
    precision = np.array([1 / prior[n][1] ** 2 if prior and n in prior else (0.0 if n == "Intercept" else ridge) for n in names])
    beta = mu.copy()
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    kept = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features] + [F.col(label)] + ([F.col(weight)] if weight else [])
    rows = Workspace(df.sparkSession, "fit").save(df.filter(F.col(label).isNotNull()).select(*kept), "rows")
    for _ in range(rounds):
        p = logistic(float(beta[0]), dict(zip(features, map(float, beta[1:]))))
        g = [F.sum(w * (y - p) * c) for c in x]
        h = [F.sum(w * p * (1 - p) * x[i] * x[j]) for i in range(d) for j in range(i, d)]
        got = list(rows.agg(*(c.alias(f"s{i}") for i, c in enumerate(g + h))).first())
        got = [0.0 if v is None else v for v in got]
        hess = np.zeros((d, d))
        hess[np.triu_indices(d)] = got[d:]
        hess = hess + np.triu(hess, 1).T + np.diag(precision)
        step = np.linalg.solve(hess + 1e-9 * np.eye(d), np.array(got[:d]) - precision * (beta - mu))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    cov = np.linalg.inv(hess + 1e-9 * np.eye(d))
    return Head(dict(zip(names, map(float, beta))), dict(zip(names, map(float, np.sqrt(np.diag(cov))))))


def anchor_frame(spark: SparkSession) -> DataFrame:
    """``copy`` and the columns of the anchor rows: a small training set that encodes what the prior is to do."""
    rows = spark.createDataFrame([tuple(map(float, r)) for r in ANCHORS], ", ".join(f"{c} double" for c in ANCHOR_COLUMNS))
    return rows.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("copy"), *ANCHOR_COLUMNS)


def default_head(spark: SparkSession, threshold: float = 0.5) -> Head:
    """The head without records: the prior, fitted to the anchor rows."""
    rows = anchor_frame(spark)
    head = fit(rows, varying(rows, [c for c in ANCHOR_COLUMNS if c != "grounded"]), "grounded", PRIOR)
    head.threshold = threshold
    return head


def summary(spark: SparkSession, head: Head) -> DataFrame:
    """``coefficient, mean, sd``, one row each."""
    return spark.createDataFrame([(k, float(v), float(head.sd.get(k, 0.0))) for k, v in head.mean.items()], "coefficient string, mean double, sd double")


def out_of_fold(df: DataFrame, features: list[str], label: str, group: str, key: str, folds: int = 3) -> DataFrame:
    """``key, label, fold, probability`` of heads fitted without the record's group; rows with a null group are one group."""
    rows = df.withColumn("fold", F.pmod(F.xxhash64(F.coalesce(F.col(group), F.lit(""))), F.lit(folds)).cast("int"))
    parts = []
    for k in range(folds):
        head = fit(rows.filter(F.col("fold") != k), features, label)
        parts.append(rows.filter(F.col("fold") == k).select(key, label, "fold", head.probability().alias("probability")))
    return reduce(DataFrame.unionByName, parts)


def update(head: Head, df: DataFrame, label: str) -> Head:
    """A refit with an earlier result as the prior."""
    features = [k for k in head.mean if k != "Intercept"]
    return fit(df, features, label, {k: (head.mean[k], max(head.sd.get(k, 1.0), 1e-3)) for k in head.mean})


def fit_balanced(df: DataFrame, features: list[str], label: str) -> Head:
    """Class-balanced fit, its threshold the best macro-F1 of 13 between .2 and .8."""
    rows = resample_weights(df, label)
    head = fit(rows, features, label, weight="weight")
    scored = df.withColumn("_score", head.probability())
    best = best_threshold(scan(scored, [], "_score", label, grid(0.2, 0.8, 13)), []).first()
    head.threshold = best["threshold"]
    return head


def evaluate(head: Head, df: DataFrame, label: str, group: str | None = None) -> DataFrame:
    """Measures at the threshold, over all and (with a null-safe total row) by group."""
    from veriscope.operators.evaluate import confusion

    scored = df.withColumn("_s", (head.probability() >= head.threshold).cast("int"))
    total = measures(confusion(scored.withColumn("scope", F.lit("all")), ["scope"], F.col(label), F.col("_s")))
    if not group:
        return total
    return total.unionByName(measures(confusion(scored.withColumn("scope", F.coalesce(F.col(group), F.lit("none"))), ["scope"], F.col(label), F.col("_s"))))
