"""Clustering and regression on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clustered(df: DataFrame, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """The rows with cluster_id from 1."""
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_cluster").fit(rows)
    return model.transform(rows).withColumn("cluster_id", F.col("_cluster") + 1).drop("_features", "_cluster")


@dataclass
class Regression:
    model: PipelineModel
    features: list[str]
    label: str
    train: DataFrame
    test: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with predicted_<label>."""
        return self.model.transform(df).withColumnRenamed("prediction", f"predicted_{self.label}").drop("_raw", "_features")

    def evaluate(self, df: DataFrame | None = None) -> dict[str, float]:
        rows = self.model.transform(self.test if df is None else df)
        of = lambda m: RegressionEvaluator(labelCol=self.label, metricName=m).evaluate(rows)
        return {"r2_score": of("r2"), "mean_absolute_error": of("mae"), "mean_squared_error": of("mse")}

    def explain(self) -> dict[str, float]:
        """Coefficients on the scaled features, the largest first."""
        weights = self.model.stages[-1].coefficients
        return dict(sorted(zip(self.features, map(float, weights), strict=True), key=lambda x: -abs(x[1])))


def regression(df: DataFrame, features: list[str], label: str, test_share: float = 0.2, seed: int = 42) -> Regression:
    """Least squares on robustly scaled features; the scaler sees the training rows only."""
    train, test = df.randomSplit([1 - test_share, test_share], seed)
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        RobustScaler(inputCol="_raw", outputCol="_features", withCentering=True),
        LinearRegression(featuresCol="_features", labelCol=label, solver="normal"),
    ]
    return Regression(Pipeline(stages=stages).fit(train), features, label, train, test)
