"""Models over the trade and combo tables, fitted by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.calibrate import regression_metrics
from tradeloom.operators.forest import by_fold
from tradeloom.operators.ordered import union_all


def out_of_fold_probabilities(df: DataFrame, features: list[str], label: str, fold: str, folds: int, rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Win probability of every row by a boosted tree model that has not seen the row's fold."""

    def work(f: int) -> DataFrame:
        stages = [
            VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"),
            GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed),
        ]
        model = Pipeline(stages=stages).fit(df.filter(F.col(fold) != f))
        scored = model.transform(df.filter(F.col(fold) == f))
        return scored.withColumn("pwin_model", vector_to_array("probability")[1]).select(*df.columns, "pwin_model")

    return by_fold(folds, work)


def out_of_fold_scores(df: DataFrame, features: list[str], target: str, fold: str, folds: int, rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Predicted target of every combo by boosted trees fitted on the other folds."""

    def work(f: int) -> DataFrame:
        model = _regressor(features, target, rounds, depth, seed).fit(df.filter(F.col(fold) != f))
        return model.transform(df.filter(F.col(fold) == f)).select(*df.columns, F.col("prediction").alias("pred"))

    return by_fold(folds, work)


def importances(df: DataFrame, features: list[str], target: str, rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Share of each feature in the splits of a model of the whole table; one row per feature."""
    model = _regressor(features, target, rounds, depth, seed).fit(df)
    weights = model.stages[-1].featureImportances
    rows = [(name, float(weights[i])) for i, name in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _regressor(features: list[str], target: str, rounds: int, depth: int, seed: int) -> Pipeline:
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    return Pipeline(stages=[assemble, GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)])


def ridge_blend(df: DataFrame, features: list[str], target: str, train: Column, penalties: list[float]) -> DataFrame:
    """Linear blends fitted on one half and scored on the other, one row per penalty."""
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    rows = assemble.transform(df.dropna(subset=[*features, target]))
    frames = []
    for penalty in penalties:
        model = LinearRegression(featuresCol="_x", labelCol=target, regParam=penalty, elasticNetParam=0.0).fit(rows.filter(train))
        scored = model.transform(rows.filter(~train))
        frames.append(regression_metrics(scored, [], "prediction", target).withColumn("penalty", F.lit(penalty)))
    return union_all(frames)
