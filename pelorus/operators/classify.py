"""Real and false components told apart: feature scaling, a multilayer perceptron, efficiency tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (8,), seed: int = 1) -> PipelineModel:
    """Features scaled to [-1, 1] and a perceptron; rows with a null or NaN feature or label are left out."""
    ok = rows.dropna(subset=[*features, label]).select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("label"))
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), MinMaxScaler(min=-1.0, max=1.0, inputCol="_raw", outputCol="features"), MultilayerPerceptronClassifier(layers=[len(features), *hidden, 2], seed=seed, maxIter=60)]
    return Pipeline(stages=stages).fit(ok)


def apply(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Add ``predicted`` (1 real, 0 false)."""
    ok = rows.dropna(subset=features)
    for f in features:
        ok = ok.withColumn(f, F.col(f).cast("double"))
    return model.transform(ok).withColumn("predicted", F.col("prediction").cast("int")).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def efficiencies(tagged: DataFrame, truth: str, predicted: str = "predicted") -> DataFrame:
    """n, efficiency (real found), purity (found real), in one pass; a share of nothing is null."""
    t, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    return tagged.agg(F.count("*").alias("n"), F.try_divide(F.sum(t * p), F.sum(t)).alias("efficiency"), F.try_divide(F.sum(t * p), F.sum(p)).alias("purity"))
