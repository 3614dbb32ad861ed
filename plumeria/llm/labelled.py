"""Bounded samples of labelled documents, held-out marks and score calibration, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5: such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_ids(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, longest: int | None = None) -> DataFrame:
    """doc_id and y of up to ``per_class`` labelled rows of each class that are not held out, chosen by a hash of their id.

    A document labelled both ways, or whose text has more than ``longest`` bytes, is left out. The sample is the same in every
    run; its bound of 2 * per_class rows does not grow with the input.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    if longest is not None:
        known = known.join(docs.where(F.octet_length("text") <= longest).select("doc_id").distinct(), "doc_id", "left_semi")
    ids = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
        ids = one if ids is None else ids.unionAll(one)
    return docs.sparkSession.createDataFrame(ids.collect(), ids.schema)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, columns: list[str], longest: int):
    """The rows of sample_ids() as a pandas frame with the label as ``y``, one for each id (the first in order of its columns)."""
    few = sample_ids(docs, labels, label, per_class, seed, longest)
    rows = docs.where(F.octet_length("text") <= longest).select("doc_id", *columns).join(F.broadcast(few), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(*columns)).alias("row")).select("doc_id", "y", "row.*")
    return one.toPandas().sort_values("doc_id").reset_index(drop=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """Coefficients, the last one the intercept, by Newton's method (x is dense and has few columns)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic_wide(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Coefficients and intercept for many columns, by accelerated gradient descent."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    look, momentum = w.copy(), 1.0
    total = weight.sum()
    rate = 1.0 / (0.25 * (weight[:, None] * x**2).sum(axis=1).max() * len(y) / total + ridge / total)
    for _ in range(rounds):
        p = sigmoid(x @ look)
        grad = x.T @ (weight * (p - y)) / total + ridge / total * look
        new = look - rate * grad
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / nxt * (new - w)
        w, momentum = new, nxt
    return w
