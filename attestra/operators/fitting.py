"""Logistic regression whose gradients are summed in Spark: only a few numbers for each fold reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prob import sigmoid
from ..session import staged


def _score(weights: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        out = out + float(w) * F.col(f)
    return out


def crossfit(rows: DataFrame, key: str, group: str, y: str, features: list[str], folds: int, ridge: float = 1.0, tolerance: float = 1e-7, most: int = 50) -> DataFrame:
    """key, fold, p: each row's probability by a fit on the other folds. Folds are by the group's digest, so a group is in one.

    Newton's method on the ridge-penalized likelihood (the intercept is free), all folds in one aggregation a step: sums over
    rows for each fold, and a fit's sums are the total less its own fold's. Stops when no weight moves by more than
    `tolerance`. Rows of a null key, group, y or feature are left out; probabilities have eight decimals.
    """
    fold = (F.conv(F.substring(F.sha2(F.col(group).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % folds).cast("int")
    data = staged(rows.dropna(subset=[key, group, y, *features]).select(key, fold.alias("fold"), F.col(y).alias("y"), *features), "observations")
    m = len(features) + 1
    weights = {k: np.zeros(m) for k in range(folds)}
    design = [F.lit(1.0), *map(F.col, features)]
    penalty = np.diag([0.0] + [ridge] * (m - 1))
    for _ in range(most):
        # for each fold's fit: the sums over the rows outside the fold
        sums = []
        for k, w in weights.items():
            p = sigmoid(_score(w, features))
            out = F.col("fold") != k
            sums += [F.sum(F.when(out, (F.col("y") - p) * x)).alias(f"g{k}_{i}") for i, x in enumerate(design)]
            sums += [F.sum(F.when(out, p * (1 - p) * design[i] * design[j])).alias(f"h{k}_{i}_{j}") for i in range(m) for j in range(i, m)]
        got = data.agg(*sums).first()
        moved = 0.0
        for k, w in weights.items():
            g = np.array([got[f"g{k}_{i}"] or 0.0 for i in range(m)]) - penalty @ w
            h = penalty + 1e-9 * np.eye(m)
            for i in range(m):
                for j in range(i, m):
                    v = got[f"h{k}_{i}_{j}"] or 0.0
                    h[i, j] += v
                    h[j, i] += v if i != j else 0.0
            step = np.linalg.solve(h, g)
            size = float(np.abs(step).max())
            step *= min(1.0, 5.0 / size) if size > 0 and math.isfinite(size) else 1.0
            weights[k] = w + step
            moved = max(moved, size)
        if moved <= tolerance:
            break
    p = F.lit(None).cast("double")
    for k, w in weights.items():
        p = F.when(F.col("fold") == k, sigmoid(_score(w, features))).otherwise(p)
    return data.select(key, "fold", F.round(p, 8).alias("p"))
