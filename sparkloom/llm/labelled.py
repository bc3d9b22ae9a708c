"""Labelled training rows, folds and fit figures shared by the two classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longer texts (bytes) are scored like all others, but aren't used for training; nor are texts of a class beyond so many bytes.
LONGEST_TRAINED, BYTES_PER_CLASS = 100_000, 24 << 20


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null: of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, columns: list[Column]) -> pa.Table:
    """Rows (doc_id, _y, _o, columns) of at most per_class ids and BYTES_PER_CLASS bytes of each class, the first by a hash
    of the id; one row an id.

    The ids are picked from the labels alone and broadcast (2 * per_class at most), so texts aren't shuffled. Null labels and
    ids labelled both ways don't count, nor do null, empty and very long texts; held-out rows are never read."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("most")).where("_y = most").drop("most")
    known = known.withColumn("_o", F.xxhash64("doc_id", F.lit(5)))
    picked = [known.where(F.col("_y") == y).orderBy("_o", "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))
    fit = docs.where(F.octet_length("text").between(1, LONGEST_TRAINED))
    sizes = fit.select("doc_id", F.octet_length("text").alias("_n")).join(ids, "doc_id").groupBy("doc_id", "_y", "_o").agg(F.max("_n").alias("_n"))
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_y").orderBy("_o", "doc_id")))  # 2 * per_class rows
    ids = F.broadcast(upto.where(F.col("_upto") <= BYTES_PER_CLASS).select("doc_id", "_y", "_o"))
    rows = fit.join(ids, "doc_id").select("doc_id", "_y", "_o", *columns).dropDuplicates(["doc_id"])
    return rows.toArrow().sort_by([("_o", "ascending"), ("doc_id", "ascending")])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Coefficients (the intercept last) by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (weights * (p - y)) + ridge * w
        hess = (a * (weights * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def class_weights(y: np.ndarray, rate: float) -> np.ndarray:
    """Weights that make a class-balanced sample stand for a population in which label 1 has this rate."""
    have = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    return np.where(y == 1, rate / have, (1 - rate) / (1 - have))
