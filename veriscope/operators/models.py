"""Model factories over feature columns: anything with ``fit(rows, label) -> transform``, here from Spark's own library."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fitted(Protocol):
    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """The rows with a column ``probability`` of class 1."""


class Factory(Protocol):
    def fit(self, rows: DataFrame, features: list[str], label: str) -> Fitted: ...


class _Estimator:
    """An estimator of Spark's library behind the two methods."""

    def __init__(self, make):  # noqa: ANN001
        self.make, self.model, self.features = make, None, []

    def fit(self, rows: DataFrame, features: list[str], label: str) -> _Estimator:
        out = _Estimator(self.make)
        out.features = features
        out.model = self.make().setLabelCol("_y").setFeaturesCol("_x").fit(self._vector(rows, features).withColumn("_y", F.col(label).cast("double")))
        return out

    @staticmethod
    def _vector(rows: DataFrame, features: list[str]) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return rows.withColumn("_x", array_to_vector(F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.model.setProbabilityCol("_q").setPredictionCol("_said").setRawPredictionCol("_raw").transform(self._vector(rows, self.features))
        return scored.withColumn("probability", vector_to_array("_q")[1]).drop("_x", "_q", "_said", "_raw")


def boosted(trees: int = 20, depth: int = 3, seed: int = 7) -> Factory:
    def make():  # noqa: ANN202
        from pyspark.ml.classification import GBTClassifier

        return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)

    return _Estimator(make)


def logistic(ridge: float = 0.01) -> Factory:
    def make():  # noqa: ANN202
        from pyspark.ml.classification import LogisticRegression

        return LogisticRegression(regParam=ridge)

    return _Estimator(make)


def out_of_fold(df: DataFrame, features: list[str], label: str, group: str, key: str, factories: dict[str, Factory], folds: int = 3) -> DataFrame:
    """``model, key, label, fold, probability``: every record scored by models fitted without its group."""
    rows = df.filter(F.col(label).isNotNull()).withColumn("fold", F.pmod(F.xxhash64(F.coalesce(F.col(group), F.lit(""))), F.lit(folds)).cast("int"))
    parts = []
    for name, factory in factories.items():
        for k in range(folds):
            fitted = factory.fit(rows.filter(F.col("fold") != k), features, label)
            parts.append(fitted.predict_proba(rows.filter(F.col("fold") == k)).select(F.lit(name).alias("model"), key, label, "fold", "probability"))
    return reduce(DataFrame.unionByName, parts)
