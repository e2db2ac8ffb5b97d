"""Logistic regression on standardised features, by Newton steps whose sums are one Spark aggregate each.

The penalty is that of a unit-strength L2 fit in which the intercept is one more, penalised, weight; scaling
uses population deviations of the training rows alone. Only sums over rows leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KIND = "standardised-logistic-1"


@dataclass
class Scaled:
    """Weights with the scaling that they expect."""

    features: list[str]
    mean: list[float]
    deviation: list[float]
    weight: list[float]
    intercept: float

    def document(self) -> dict:
        """The model as a JSON document, from which ``of`` makes it again."""
        return {"kind": KIND, "features": self.features, "mean": self.mean, "deviation": self.deviation, "weight": self.weight, "intercept": self.intercept}

    @classmethod
    def of(cls, document: dict) -> Scaled:
        if document.get("kind") != KIND:
            raise ValueError("not a document of this kind of model")
        return cls(*(document[k] for k in ("features", "mean", "deviation", "weight", "intercept")))

    def inputs(self) -> list[Column]:
        return [(F.col(f) - F.lit(m)) / F.lit(d) for f, m, d in zip(self.features, self.mean, self.deviation, strict=True)]

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for w, x in zip(self.weight, self.inputs(), strict=True):
            z = z + F.lit(w) * x
        return 1 / (1 + F.exp(-z))


def scaling(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean (m0, m1, ...) and population deviation (d0, d1, ...) of each feature."""
    return rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"d{i}") for i, f in enumerate(features)])


def fit(rows: DataFrame, features: list[str], label: str = "y", strength: float = 1.0, steps: int = 25, tolerance: float = 1e-10) -> Scaled:
    """The exact optimum up to ``tolerance``; a feature that does not vary is only centred."""
    stats = scaling(rows, features).first()
    n = len(features)
    if stats["m0"] is None:
        raise ValueError("no training rows")
    model = Scaled(features, [stats[f"m{i}"] for i in range(n)], [stats[f"d{i}"] or 1.0 for i in range(n)], [0.0] * n, 0.0)
    x = rows.select(F.col(label).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(model.inputs())], F.lit(1.0).alias(f"x{n}"))
    beta = np.zeros(n + 1)
    for _ in range(steps):
        z = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
        sums = x.withColumn("p", p).agg(
            *[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(n + 1)],
            *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        gradient = strength * np.array([sums[f"g{i}"] for i in range(n + 1)]) + beta
        curve = np.eye(n + 1)
        for i, j in pairs:
            curve[i, j] += strength * sums[f"h{i}_{j}"]
            if i != j:
                curve[j, i] += strength * sums[f"h{i}_{j}"]
        move = np.linalg.solve(curve, gradient)
        beta = beta - move
        if np.abs(move).max() < tolerance:
            break
    model.weight, model.intercept = [float(b) for b in beta[:n]], float(beta[n])
    return model


def predict(rows: DataFrame, model: Scaled, label: str = "label") -> DataFrame:
    """Rows with p_up, the predicted label and whether it is right."""
    x = rows.withColumn("p_up", model.probability())
    x = x.withColumn("predicted_label", F.when(F.col("p_up") >= 0.5, "UP").otherwise("DOWN"))
    return x.withColumn("correct", F.col("predicted_label") == F.col(label))
