"""Linear classifiers with the squared hinge loss, by Newton steps for all classes at once.

Each class is told from the rest by half the squared weights, the shift among them, plus C times
the summed squared shortfalls. A Newton step takes a pass for the slopes and one that tries
several step lengths together. Its direction solves a system by the curvature of the rows that
fall short: while the matrices of all classes have at most MATRIX_NUMBERS they are summed in one
pass, beyond that they are never formed, and conjugate gradients take one pass for each product
of them with a vector. A table that one task can hold takes its steps there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from layerlens.operators.perceptron import gathered, released, stored_blocks, summed
from layerlens.session import dropped, new_folder

TOLERANCE = 1e-4  # of the first slope, where Newton steps stop
INNER_TOLERANCE, INNER_STEPS = 0.1, 50
MATRIX_NUMBERS = 4_000_000
STEPS = tuple(0.5**i for i in range(8))
ARMIJO = 1e-4


@dataclass
class LinearMargins:
    """weights: one column per class told from the rest, the last row its shift."""

    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.weights[:-1] + self.weights[-1]
        return np.concatenate([-out, out], axis=1) if out.shape[1] == 1 else out

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights.tolist()})

    @staticmethod
    def from_json(text: str) -> LinearMargins:
        return LinearMargins(np.array(json.loads(text)["weights"]))


def _sides(target: np.ndarray, columns: int) -> np.ndarray:
    """1 for the class of each column, -1 for the rest."""
    classes = [1] if columns == 1 else np.arange(columns)
    return np.where(target[:, None] == classes, 1.0, -1.0)


def _wide(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _slope(x, target, weights):
    """Summed losses and their slopes."""
    x, y = _wide(x), _sides(target, weights.shape[1])
    short = np.maximum(1 - y * (x @ weights), 0)
    return np.concatenate([(short**2).sum(axis=0), (-2 * x.T @ (y * short)).ravel()])


def _matrices(x, target, weights):
    """The curvature of the losses of each class."""
    x, y = _wide(x), _sides(target, weights.shape[1])
    short = y * (x @ weights) < 1
    return np.concatenate([(2 * x[rows].T @ x[rows]).ravel() for rows in short.T])


def _product(x, target, state):
    """The curvature of the losses times a vector for each class."""
    weights, vectors = state
    x, y = _wide(x), _sides(target, weights.shape[1])
    short = y * (x @ weights) < 1
    return (2 * x.T @ (short * (x @ vectors))).ravel()


def _losses(x, target, state):
    """Summed losses at all step lengths."""
    weights, way = state
    x, y = _wide(x), _sides(target, weights.shape[1])
    here, ahead = x @ weights, x @ way
    return np.concatenate([(np.maximum(1 - y * (here + t * ahead), 0) ** 2).sum(axis=0) for t in STEPS])


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=0)


def _conjugate(slope: np.ndarray, bent_by: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """About the Newton direction of each column, from products with the curvature alone."""
    way, left = np.zeros_like(slope), -slope
    ahead, square = left.copy(), _inner(left, left)
    enough = INNER_TOLERANCE * np.sqrt(square)
    for _ in range(INNER_STEPS):
        active = np.sqrt(square) > enough
        if not active.any():
            break
        bent = bent_by(ahead)
        length = np.where(active, square / np.maximum(_inner(ahead, bent), 1e-300), 0)
        way, left = way + length * ahead, left - length * bent
        after = _inner(left, left)
        ahead = np.where(active, left + after / np.maximum(square, 1e-300) * ahead, ahead)
        square = np.where(active, after, square)
    return way


def fit(train: DataFrame, dims: int, classes: int, c: float, steps: int = 1000, seed: int = 42) -> LinearMargins:
    """Fits (id, features, target) with targets 0 .. classes - 1, each class against the rest."""
    spark = train.sparkSession
    folder = new_folder(spark, "hinge")
    (blocks,) = stored_blocks(train, 1, seed, folder)
    tasks, columns = blocks.getNumPartitions(), 1 if classes <= 2 else classes
    if gathered(blocks.map(lambda row: len(row[0]) // 8).sum()):
        (weights,) = blocks.coalesce(1).mapPartitions(lambda rows: [_solved_here(rows, dims, columns, c, steps)]).collect()
    else:
        weights = _solved(lambda *of: summed(blocks, tasks, dims, *of), dims, columns, c, steps)
    released(blocks)
    dropped(spark, folder)
    return LinearMargins(weights)


def _solved_here(rows, dims: int, columns: int, c: float, steps: int) -> np.ndarray:
    """All steps over the blocks of this task."""
    held = [(np.frombuffer(x).reshape(-1, dims), np.frombuffer(target, np.int32)) for x, target in rows]

    def aggregated(size, of_block, state):
        total = np.zeros(size)
        for x, target in held:
            total += of_block(x, target, state)
        return total

    return _solved(aggregated, dims, columns, c, steps)


def _solved(aggregated: Callable, dims: int, columns: int, c: float, steps: int) -> np.ndarray:
    """The weights by Newton steps; aggregated(size, of_block, state) sums over all rows."""
    shape = dims + 1, columns
    weights, first = np.zeros(shape), None
    for _ in range(steps):
        sums = aggregated(columns * (dims + 2), _slope, weights)
        slope = weights + c * sums[columns:].reshape(shape)
        value = 0.5 * _inner(weights, weights) + c * sums[:columns]
        size = np.sqrt(_inner(slope, slope))
        first = size if first is None else first
        if (size <= TOLERANCE * first).all():
            break
        if columns * (dims + 1) ** 2 <= MATRIX_NUMBERS:
            bent = aggregated(columns * (dims + 1) ** 2, _matrices, weights).reshape(columns, dims + 1, dims + 1)
            way = np.linalg.solve(np.eye(dims + 1) + c * bent, -slope.T[:, :, None])[:, :, 0].T
        else:
            way = _conjugate(slope, lambda v: v + c * aggregated(weights.size, _product, (weights, v)).reshape(shape))
        losses = aggregated(columns * len(STEPS), _losses, (weights, way)).reshape(len(STEPS), columns)
        tried = np.stack([0.5 * _inner(weights + t * way, weights + t * way) for t in STEPS]) + c * losses
        enough = tried <= value + ARMIJO * np.array(STEPS)[:, None] * _inner(slope, way)
        chosen = np.where(enough.any(axis=0), np.array(STEPS)[enough.argmax(axis=0)], 0)
        if not chosen.any():
            break  # at the limit of the arithmetic
        weights = weights + chosen * way
    return weights
