"""Kernel classifiers by landmarks (Nyström): any kernel, squared hinge loss, all classes at once.

A bounded number of training rows are landmarks. A row is mapped by its kernel with the
landmarks so that products of mapped rows are the kernel between landmarks exactly and close to
it elsewhere; how close is measured on further rows and kept with the model. On mapped rows the
classifier is the linear one. A kernel that is no product of any map (the sigmoid one) is taken
without its negative part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from layerlens.functions.draws import draw
from layerlens.operators.hinge import LinearMargins, fit as fit_margins

#: Landmarks, and further rows that the error is measured on.
LANDMARKS, MEASURED = 256, 64
PIECE_ROWS = 1024
# The degree and the constant of the polynomial and sigmoid kernels.
DEGREE, CONSTANT = 3, 0.0


def kernel_matrix(kernel: str, gamma: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    product = x @ y.T
    if kernel == "linear":
        return product
    if kernel == "poly":
        return (gamma * product + CONSTANT) ** DEGREE
    if kernel == "sigmoid":
        return np.tanh(gamma * product + CONSTANT)
    if kernel == "rbf":
        squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * product
        return np.exp(-gamma * np.maximum(squares, 0))
    raise ValueError(f"Unknown kernel: {kernel}")


@dataclass
class KernelMargins:
    """`error` is the mean error of the mapped products over the mean of the kernel itself."""

    kernel: str
    gamma: float
    landmarks: np.ndarray
    maps: np.ndarray
    error: float
    margins: LinearMargins | None = None

    def mapped(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return x  # is its own map
        return kernel_matrix(self.kernel, self.gamma, x, self.landmarks) @ self.maps

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.margins.scores(self.mapped(x))

    def to_json(self) -> str:
        return json.dumps({
            "kernel": self.kernel, "gamma": self.gamma, "landmarks": self.landmarks.tolist(), "maps": self.maps.tolist(),
            "error": self.error, "weights": self.margins.weights.tolist(),
        })

    @staticmethod
    def from_json(text: str) -> KernelMargins:
        a = json.loads(text)
        return KernelMargins(
            a["kernel"], a["gamma"], np.array(a["landmarks"]), np.array(a["maps"]), a["error"], LinearMargins(np.array(a["weights"]))
        )


def landmark_map(train: DataFrame, kernel: str, gamma: float, seed: int = 42) -> KernelMargins:
    """The map of a kernel by the rows of lowest draws."""
    if kernel == "linear":
        return KernelMargins(kernel, gamma, np.empty((0, 0)), np.empty((0, 0)), 0.0)
    drawn = train.select("features", "id", draw(F.col("id"), seed).alias("draw")).orderBy("draw", "id")
    rows = np.array([r.features for r in drawn.limit(LANDMARKS + MEASURED).collect()], np.float64)
    landmarks, further = rows[:LANDMARKS], rows[LANDMARKS:]
    values, vectors = np.linalg.eigh(kernel_matrix(kernel, gamma, landmarks, landmarks))
    kept = values > 1e-10 * max(values.max(), 1e-300)
    if not kept.any():
        raise ValueError(f"The {kernel} kernel is 0 on all landmarks")
    out = KernelMargins(kernel, gamma, landmarks, vectors[:, kept] / np.sqrt(values[kept]), 0.0)
    if len(further):
        want, near = kernel_matrix(kernel, gamma, further, further), out.mapped(further)
        out.error = float(np.abs(want - near @ near.T).mean() / max(np.abs(want).mean(), 1e-300))
    return out


def fit(train: DataFrame, dims: int, classes: int, c: float, kernel: str, gamma: float, seed: int = 42) -> KernelMargins:
    """Fits (id, features, target) with targets 0 .. classes - 1, each class against the rest."""
    model = landmark_map(train, kernel, gamma, seed)
    if kernel == "linear":
        model.margins = fit_margins(train, dims, classes, c, seed=seed)
        return model

    @F.pandas_udf("array<double>")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            for start in range(0, len(vectors), PIECE_ROWS):
                yield pd.Series(list(model.mapped(np.stack(vectors.iloc[start : start + PIECE_ROWS].to_list()))))

    rows = train.withColumn("features", mapped("features"))
    model.margins = fit_margins(rows, model.maps.shape[1], classes, c, seed=seed)
    return model
