"""Bounded samples of labelled rows, and the small fits that several classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(id: str, salt: int = 0) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    return (F.xxhash64(F.col(id), F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def sample_labels(labels: DataFrame, label: str, bound: int, keep: Column | None = None, id: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """About ``bound`` labelled ids of each class, and how many ids one of them stands for.

    The draw goes by a hash of the id, so it is the same on every run and layout;
    all ids of a class are taken where there are no more than ``bound``.  An id
    with several labels takes the largest; null ids and labels are no examples.
    Returns rows (id, y) and the classes' weights.
    """
    got = labels.select(F.col(f"`{id}`").alias(id), F.col(f"`{label}`").alias("y")).filter(F.col(id).isNotNull() & F.col("y").isNotNull())
    if keep is not None:
        got = got.filter(keep)
    got = got.groupBy(id).agg(F.max("y").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}  # one row a class
    rate = F.lit(0.0)
    for y, c in n.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, bound / c))).otherwise(rate)
    return got.filter(share(id) < rate), {y: max(1.0, c / bound) for y, c in n.items()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    v = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (v * (p - y)) + pull * w
        h = (x * (v * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    _, inv, c = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(c) - (c - 1) / 2)[inv]
    n1 = int(y.sum())
    n0 = len(y) - n1
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n0 * n1))
