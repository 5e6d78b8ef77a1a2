"""Class probabilities from a classifier's scores, by a sigmoid per class fitted to held-out rows.

The two parameters of a sigmoid take a few Newton steps, whose sums over the held-out rows are
aggregates; one pass serves all classes. Targets are pulled in a little from 0 and 1 by the
classes' counts, so that scores that part the classes give finite parameters.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from layerlens.operators.perceptron import released, stored_blocks, summed
from layerlens.session import dropped, new_folder

ROUNDS, TOLERANCE = 100, 1e-7
STEPS = tuple(0.5**i for i in range(12))
RIDGE = 1e-12


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Calibrated:
    """A model with `scores`, and per class the slope and the shift of its sigmoid."""

    model: Any
    slopes: np.ndarray
    shifts: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.model.scores(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = _sigmoid(self.model.scores(x)[:, -len(self.slopes) :] * self.slopes + self.shifts)
        if p.shape[1] == 1:
            return np.concatenate([1 - p, p], axis=1)
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.maximum(total, 1e-300), 1 / p.shape[1])

    def to_json(self) -> str:
        return json.dumps({"model": self.model.to_json(), "slopes": self.slopes.tolist(), "shifts": self.shifts.tolist()})

    @staticmethod
    def from_json(text: str, kind) -> Calibrated:
        about = json.loads(text)
        return Calibrated(kind.from_json(about["model"]), np.array(about["slopes"]), np.array(about["shifts"]))


def _loss(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (np.logaddexp(0, z) - t * z).sum(axis=0)


def _columns(x: np.ndarray, target: np.ndarray, state):
    """The scores of the classes that have a sigmoid, and the targets of their rows."""
    own, other = state[-1]
    k = len(own)
    is_own = target[:, None] == (np.arange(k) if k > 1 else [1])
    return x[:, -k:], np.where(is_own, own, other)


def _slope(x, target, state):
    a, b, _ = state
    f, t = _columns(x, target, state)
    p = _sigmoid(f * a + b)
    w, gap = p * (1 - p), p - t
    return np.concatenate([v.sum(axis=0) for v in (gap * f, gap, w * f * f, w * f, w)] + [_loss(f * a + b, t)])


def _losses(x, target, state):
    a, b, da, db, _ = state
    f, t = _columns(x, target, state)
    return np.concatenate([_loss(f * (a + s * da) + b + s * db, t) for s in STEPS])


def fit(scored: DataFrame, classes: int, counts: list[int], seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and shifts from (id, features, target), the features being the scores of all
    classes; `counts` has the rows of each class."""
    spark = scored.sparkSession
    folder = new_folder(spark, "calibration")
    (blocks,) = stored_blocks(scored, 1, seed, folder)
    tasks, width, k = blocks.getNumPartitions(), max(classes, 2), 1 if classes <= 2 else classes
    n = np.array([counts[1] if len(counts) > 1 else 0] if k == 1 else counts, float)
    targets = (n + 1) / (n + 2), 1 / (sum(counts) - n + 2)
    a, b = np.zeros(k), np.log((n + 1) / (sum(counts) - n + 1))
    for _ in range(ROUNDS):
        ga, gb, haa, hab, hbb, value = summed(blocks, tasks, width, 6 * k, _slope, (a, b, targets)).reshape(6, k)
        if (np.abs(ga) + np.abs(gb) <= TOLERANCE * max(sum(counts), 1)).all():
            break
        haa, hbb = haa + RIDGE, hbb + RIDGE
        spread = np.maximum(haa * hbb - hab * hab, 1e-300)
        da, db = -(hbb * ga - hab * gb) / spread, -(haa * gb - hab * ga) / spread
        tried = summed(blocks, tasks, width, len(STEPS) * k, _losses, (a, b, da, db, targets)).reshape(len(STEPS), k)
        enough = tried <= value + 1e-4 * np.array(STEPS)[:, None] * (ga * da + gb * db)
        step = np.where(enough.any(axis=0), np.array(STEPS)[enough.argmax(axis=0)], 0)
        if not step.any():
            break
        a, b = a + step * da, b + step * db
    released(blocks)
    dropped(spark, folder)
    return a, b
