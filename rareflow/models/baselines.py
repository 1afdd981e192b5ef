"""Classic baselines and searches on pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from rareflow.models.dan import DisguiseClassifier, DisguiseModel, Training
from rareflow.models.kernel import Shape
from rareflow.models.penalised import PenaltyPath
from rareflow.operators.matrix import abs_diff, l1
from rareflow.operators.ordering import HashOrder


def as_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))


def logistic_regression(train: DataFrame, label: str, features: str = "features",
                        c: float | None = 1.0, rows: int | None = None) -> LogisticRegressionModel:
    """Logistic regression with an L2 penalty of inverse strength ``c``."""
    n = rows or train.count()
    reg = 0.0 if c is None else 1.0 / (c * n)
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=reg,
                              standardization=False, maxIter=100).fit(train)


def positive_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", vector_to_array("probability")[1])


def as_arrays(df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with ``features`` as an array, if it is an ml vector."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(features, vector_to_array(features))
    return df


def tune_on_validation(train: DataFrame, validation: DataFrame, label: str,
                       features: str = "features",
                       grid: Sequence[float] = tuple(np.linspace(0.001, 100, 30))) -> DataFrame:
    """(c, auroc) of every penalty on a fixed validation set, best first.

    All penalties are fitted in the same passes over ``train`` and scored in one over
    ``validation``.
    """
    path = PenaltyPath(as_arrays(train, features), label, features, grid)
    return path.auroc(as_arrays(validation, features), label).orderBy(
        F.desc_nulls_last("auroc"), "c")


def refit_train_plus_validation(train: DataFrame, validation: DataFrame, label: str,
                                features: str = "features", c: float = 1.0
                                ) -> LogisticRegressionModel:
    return logistic_regression(train.unionByName(validation), label, features, c)


def random_forest_cv(df: DataFrame, key: str, label: str, features: str = "features",
                     trees: int = 20, folds: int = 5, seed: int = 42) -> CrossValidatorModel:
    """Random forest with folds that keep the class shares; scored by accuracy."""
    folded = HashOrder(df, key, "fold", label).positions("__pos").withColumn(
        "fold", (F.col("__pos") % folds).cast("int")).drop("__pos")
    forest = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees,
                                    seed=seed)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return CrossValidator(
        estimator=forest, estimatorParamMaps=ParamGridBuilder().addGrid(
            forest.numTrees, [trees]).build(),
        evaluator=judge, numFolds=folds, foldCol="fold", parallelism=2).fit(folded)


def gaussian_nb(df: DataFrame, features: Sequence[str], label: str,
                priors: Sequence[float] = (0.9, 0.1), smoothing: float = 1e-9) -> Column:
    """Positive-class probability of Gaussian naive Bayes with given priors, as a
    column expression. Reads one moment row per class."""
    aggs = [f(c).alias(f"{n}_{c}") for c in features for n, f in
            (("mean", F.avg), ("var", F.var_pop))]
    rows = {r[label]: r for r in df.groupBy(label).agg(*aggs).collect()}
    overall = df.agg(*[F.var_pop(c).alias(c) for c in features]).first()
    floor = smoothing * max(overall[c] for c in features)

    def log_likelihood(value: int) -> Column:
        out = F.lit(math.log(priors[value]))
        for c in features:
            mean, var = rows[value][f"mean_{c}"], rows[value][f"var_{c}"] + floor
            out = out - 0.5 * math.log(2.0 * math.pi * var) \
                - (F.col(c) - mean) * (F.col(c) - mean) / (2.0 * var)
        return out

    return F.lit(1.0) / (F.lit(1.0) + F.exp(log_likelihood(0) - log_likelihood(1)))


def mlp_baseline(df: DataFrame, num_inputs: int, label: str, features: str = "features",
                 training: Training = Training(epochs=3)) -> DisguiseModel:
    """Dense 4-4-2 softmax network."""
    shape = Shape(num_inputs, (4, 4), batch_norm=False)
    return DisguiseClassifier(shape, training, features, label).fit(df)


def sweep(train: DataFrame, validation: DataFrame, shape: Shape, training: Training,
          lambdas: Sequence[float], etas: Sequence[float], activations: Sequence[str] = ("relu",),
          label: str = "label", features: str = "features"
          ) -> list[tuple[dict, DisguiseModel, dict]]:
    """Train once per (lambda, eta, activation); settings, model, validation metrics.

    The trials run one after another: each already uses the whole cluster.
    """
    out = []
    for lambd in lambdas:
        for eta in etas:
            for activation in activations:
                trial = Training(**{**training.__dict__, "lambd": lambd, "eta": eta})
                net = Shape(**{**shape.__dict__, "activation": activation})
                model = DisguiseClassifier(net, trial, features, label).fit(train)
                settings = {"lambd": lambd, "eta": eta, "activation": activation}
                out.append((settings, model, model.evaluate(validation, label)))
    return out


def disguise_effect(negatives: DataFrame, trials: Sequence[tuple[dict, DisguiseModel, dict]]
                    ) -> DataFrame:
    """(lambd, activation, rows, mean L1 change) of all negatives under each trial."""
    parts = []
    for settings, model, _ in trials:
        moved = model.disguise(negatives).select(
            F.lit(float(settings["lambd"])).alias("lambd"),
            F.lit(settings["activation"]).alias("activation"),
            l1(abs_diff("embedded", "disguised")).alias("shift"))
        parts.append(moved.groupBy("lambd", "activation").agg(
            F.count("*").alias("rows"), F.avg("shift").alias("mean_shift")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
