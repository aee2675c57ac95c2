"""Scoring: fixed linear models in Catalyst, fitting by Spark ML."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import text as T


def dot(values: Column, weights: list[float], bias: float = 0.0) -> Column:
    """``bias + sum(x * w)``; a width that differs from the model's raises."""
    w = F.array(*[F.lit(float(x)) for x in weights])

    def total(v: Column) -> Column:
        out = F.aggregate(F.zip_with(v, w, lambda x, y: x.cast("double") * y), F.lit(float(bias)), lambda a, x: a + x)
        return F.when(F.size(v) == len(weights), out).otherwise(F.raise_error(F.lit("feature width differs from the model's")).cast("double"))

    return T.let(values, total)


def sigmoid(z: Column) -> Column:
    """Stable logistic function."""
    return T.let(z, lambda z: F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z))))


def logistic(values: Column, weights: list[float], bias: float) -> Column:
    return sigmoid(dot(values, weights, bias))


def softmax(values: Column, weights: list[list[float]], biases: list[float]) -> Column:
    """Class probabilities, shifted by the largest logit."""
    z = F.array(*[dot(values, w, b) for w, b in zip(weights, biases, strict=True)])
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def mlp(values: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Forward pass of linear layers with ReLU between and sigmoids last; one score for each output."""
    for k, (weights, biases) in enumerate(layers):
        last = k == len(layers) - 1
        out = [dot(values, w, b) for w, b in zip(weights, biases, strict=True)]
        values = F.array(*[sigmoid(z) if last else F.greatest(z, F.lit(0.0)) for z in out])
    return values


def fixed_weights(rows: int, columns: int) -> list[list[float]]:
    """A deterministic matrix of multiples of 1/8, for queries that two engines must agree on."""
    return [[((7 * i + 3 * j + 1) % 17 - 8) / 8 for j in range(columns)] for i in range(rows)]


def class_weights(rows: DataFrame, label: str = "label", mode: str = "balanced") -> DataFrame:
    """``(label, weight)``: one, inverse frequency or its square root, mean 1 over the classes."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    raw = F.col("total") / (F.col("k") * F.col("n"))
    raw = {"none": F.lit(1.0), "balanced": raw, "sqrt": F.sqrt(raw)}[mode]
    weighted = counts.crossJoin(F.broadcast(total)).withColumn("raw", raw)  # one row
    mean = weighted.agg(F.avg("raw").alias("mean"))
    return weighted.crossJoin(F.broadcast(mean)).select(label, "n", (F.col("raw") / F.col("mean")).alias("weight"))


def fit_logistic(rows: DataFrame, features: str = "features", label: str = "label", penalty: float = 0.001):
    """Distributed logistic regression with balanced class weights; returns ``(weights, bias)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weights = class_weights(rows, label).select(F.col(label).alias("__of"), "weight")
    train = rows.join(F.broadcast(weights), F.col(label) == F.col("__of")).select(array_to_vector(features).alias("x"), F.col(label).cast("double").alias("y"), "weight")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=penalty, maxIter=50).fit(train)
    return list(map(float, model.coefficients)), float(model.intercept)


def prior_logit(positive: int, negative: int) -> float:
    return math.log((positive + 0.5) / (negative + 0.5))


def fit_heads(rows: DataFrame, labels: list[str], features: str = "features", penalty: float = 0.001, mix: float = 0.05, most: float = 20.0) -> dict[str, tuple[list[float], float]]:
    """Independent logistic heads by Spark ML: ``{label: (weights, bias)}`` for 0/1 columns, null being no example.

    Elastic net of share ``mix``; positives weigh as much as negatives, but ``most`` times at most. A head
    that has seen one class is the constant of that class. ``features`` is an array or an ML vector, sparse ones too.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dense = rows.schema[features].dataType.typeName() == "array"
    vector = array_to_vector(features) if dense else F.col(features)
    held = rows.select(vector.alias("x"), *[F.col(f"`{c}`") for c in labels]).persist()
    try:
        first = held.where("x is not null").select(F.size(vector_to_array("x"))).first()  # one row: all are of one width, or fitting raises
        return _fit_held(held, labels, first[0] if first else 0, penalty, mix, most)
    finally:
        held.unpersist()


def _fit_held(rows: DataFrame, labels: list[str], width: int, penalty: float, mix: float, most: float) -> dict[str, tuple[list[float], float]]:
    from pyspark.ml.classification import LogisticRegression

    counts = rows.agg(*[F.count_if(F.col(f"`{c}`") == v).alias(f"{c}{v}") for c in labels for v in (0, 1)]).first()
    out = {}
    for c in labels:
        negative, positive = counts[f"{c}0"], counts[f"{c}1"]
        if not negative or not positive:
            out[c] = ([0.0] * width, 20.0 if positive else -20.0)
            continue
        weight = F.when(F.col(f"`{c}`") == 1, min(most, negative / positive)).otherwise(1.0)
        train = rows.where(F.col(f"`{c}`").isin(0, 1)).select("x", F.col(f"`{c}`").cast("double").alias("y"), weight.alias("w"))
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=penalty, elasticNetParam=mix, maxIter=50).fit(train)
        out[c] = (list(map(float, model.coefficients)), float(model.intercept))
    return out
