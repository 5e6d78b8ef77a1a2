"""A perceptron of rectified units with a penalty on its weights, trained by mini-batches.

Rows are dealt to batches once and stored by batch. A step reads one batch: tasks add up the
gradients of their rows, the sums are added up (in an exchange first where there are many) and
the driver takes one step whose length adapts to each weight (first and second moments, as in
Adam). The batches of an epoch come in another order each time. Training stops when the mean
loss has not fallen by TOLERANCE for PATIENCE epochs. What reaches the driver per step are at most
DIRECT_TASKS gradients, each as large as the weights, however many tasks there are.

A step of a small table is less work than the job it takes. The rows of a table that one task can
hold are gathered in one, which takes the same steps over the same batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from layerlens.session import dropped, new_folder

#: Rows of a batch at least, and batches of an epoch at most: a step of a large table takes more
#: rows instead of an epoch taking more steps.
BATCH_ROWS, MAX_BATCHES = 200, 32
#: Rows of a block at most, and numbers in it.
BLOCK_ROWS, BLOCK_NUMBERS = 10_000, 1_000_000
TOLERANCE, PATIENCE = 1e-4, 10
# The decay of the moments and what keeps the division safe.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8
#: Tasks whose gradients are added up on the driver; more are added up in exchanges first.
DIRECT_TASKS = 4
#: Numbers that a task of a step should have at least.
TASK_NUMBERS = 250_000
#: Tables that would give at most so many tasks are trained inside one.
GATHERED_TASKS = 48


@dataclass
class Perceptron:
    """weights and shifts of each layer; `losses` has the mean loss of each epoch."""

    weights: list[np.ndarray]
    shifts: list[np.ndarray]
    losses: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = _forward(x, self.weights, self.shifts)[-1]
        return np.concatenate([1 - out, out], axis=1) if out.shape[1] == 1 else out

    def to_json(self) -> str:
        return json.dumps({
            "weights": [w.tolist() for w in self.weights], "shifts": [b.tolist() for b in self.shifts], "losses": self.losses,
        })

    @staticmethod
    def from_json(text: str) -> Perceptron:
        about = json.loads(text)
        return Perceptron([np.array(w) for w in about["weights"]], [np.array(b) for b in about["shifts"]], about["losses"])


def _forward(x: np.ndarray, weights, shifts) -> list[np.ndarray]:
    """The outputs of all layers; the last are probabilities, of the second class where it is one."""
    out = [x]
    for i, (w, b) in enumerate(zip(weights, shifts)):
        z = out[-1] @ w + b
        if i + 1 < len(weights):
            z = np.maximum(z, 0)
        elif z.shape[1] == 1:
            z = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        out.append(z)
    return out


def _sums(x: np.ndarray, target: np.ndarray, weights, shifts) -> np.ndarray:
    """Rows, summed loss and summed gradients of all weights and shifts, in one row of numbers."""
    outs = _forward(x, weights, shifts)
    p = np.clip(outs[-1], 1e-15, 1 - 1e-15)
    delta = outs[-1].copy()
    if p.shape[1] == 1:
        hit = np.where(target[:, None] == 1, p, 1 - p)[:, 0]
        delta[:, 0] -= target
    else:
        hit = p[np.arange(len(target)), target]
        delta[np.arange(len(target)), target] -= 1
    parts = []
    for i in range(len(weights) - 1, -1, -1):
        parts[:0] = [(outs[i].T @ delta).ravel(), delta.sum(axis=0)]
        if i:
            delta = (delta @ weights[i].T) * (outs[i] > 0)
    return np.concatenate([[len(x), -np.log(hit).sum()], *parts])


def stored_blocks(train: DataFrame, batches: int, seed: int, folder: str) -> list[RDD]:
    """Blocks (x, target) of each batch.

    A step is one small job, so that the plan of the stored rows is made once and not in each step.
    Cached blocks that are lost are read from the folder again.
    """
    spark = train.sparkSession
    dealt = train.select(_batch(batches, seed), "features", "target")
    if batches > 1:
        dealt = dealt.sortWithinPartitions("batch")

    def run(parts):
        for part in parts:
            width = len(part.column("features").flatten()) // max(part.num_rows, 1)
            most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(width, 1)))
            for first in range(0, part.num_rows, most):
                piece = part.slice(first, most)
                number = piece.column("batch").to_numpy()
                x = _vectors(piece.column("features"))
                target = piece.column("target").to_numpy().astype(np.int32)
                for b in np.unique(number):
                    rows = np.flatnonzero(number == b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(b)], pa.int32()), pa.array([x[rows].tobytes()], pa.binary()), pa.array([target[rows].tobytes()], pa.binary())],
                        names=["batch", "x", "target"],
                    )

    dealt.mapInArrow(run, "batch int, x binary, target binary").write.partitionBy("batch").parquet(folder)
    whole = spark.read.schema("x binary, target binary, batch int").parquet(folder)
    held = whole.groupBy("batch").agg(F.sum(F.octet_length("x")).alias("bytes")).orderBy("batch").collect()
    return [
        cached(spark.read.schema("x binary, target binary").parquet(f"{folder}/batch={r.batch}"), r.bytes // 8) for r in held
    ]


def _batch(batches: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch")


def _vectors(column: pa.ListArray) -> np.ndarray:
    """One row per list, all of one length."""
    if column.null_count:
        raise ValueError("There are rows without features")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def cached(blocks: DataFrame, numbers: int) -> RDD:
    """The rows of stored blocks as tuples of bytes, kept on the executors while they are used.

    Few numbers are not dealt over more tasks than they are worth.
    """
    rows = blocks.rdd.coalesce(max(1, math.ceil(numbers / TASK_NUMBERS)))
    return rows.mapPartitions(lambda rows: (tuple(map(bytes, r)) for r in rows)).persist(StorageLevel.MEMORY_AND_DISK)


def released(*blocks: RDD) -> None:
    for kept in blocks:
        kept.unpersist()


def summed(blocks: RDD, tasks: int, dims: int, size: int, of_block: Callable, state) -> np.ndarray:
    """The sum over all blocks of of_block(x, target, state), which gives `size` numbers.

    Tasks add up their own blocks; the sums of many tasks are added up in exchanges before
    the driver adds the rest.
    """

    def run(index, rows):
        total = np.zeros(size)
        for x, target in rows:
            total += of_block(np.frombuffer(x).reshape(-1, dims), np.frombuffer(target, np.int32), state)
        yield index, total

    def add(index, rows):
        total = np.zeros(size)
        for _, part in rows:
            total += part
        yield index, total

    sums = blocks.mapPartitionsWithIndex(run)
    while tasks > max(DIRECT_TASKS, 1):
        tasks = math.isqrt(tasks)
        sums = sums.partitionBy(tasks, int).mapPartitionsWithIndex(add)
    return sum((part for _, part in sums.collect()), np.zeros(size))


def gathered(numbers: int) -> bool:
    """Whether a table of so many numbers is trained inside one task."""
    return numbers <= GATHERED_TASKS * TASK_NUMBERS


def in_one_task(rows: DataFrame, work: Callable) -> str:
    """The text that work(batches) makes of all rows, given as the Arrow batches of one task."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([work(batches)], pa.string())], names=["made"])

    return rows.coalesce(1).mapInArrow(run, "made string").collect()[0].made


def _of_block(x: np.ndarray, target: np.ndarray, state) -> np.ndarray:
    return _sums(x, target, *state)


def _start(layers: list[int], seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Uniform weights whose spread keeps the units' spread from layer to layer."""
    rng = np.random.default_rng(seed)
    weights, shifts = [], []
    for a, b in zip(layers, layers[1:]):
        bound = math.sqrt((2 if layers[-1] == 1 and b == layers[-1] else 6) / (a + b))
        weights.append(rng.uniform(-bound, bound, (a, b)))
        shifts.append(rng.uniform(-bound, bound, b))
    return weights, shifts


def fit(train: DataFrame, rows: int, dims: int, classes: int, hidden: tuple[int, ...], alpha: float = 1e-4,
        rate: float = 1e-3, epochs: int = 1000, seed: int = 42) -> Perceptron:
    """Fits (id, features, target) with targets 0 .. classes - 1.

    `alpha` is the penalty on the squared weights, `rate` the first length of a step.
    """
    layers = [dims, *hidden, 1 if classes <= 2 else classes]
    parts = max(1, min(math.ceil(rows / BATCH_ROWS), MAX_BATCHES))
    if gathered(rows * dims):
        dealt = train.select(_batch(parts, seed), "features", "target")
        made = in_one_task(dealt, lambda batches: _trained_on(batches, dims, layers, alpha, rate, epochs, seed).to_json())
        return Perceptron.from_json(made)
    spark = train.sparkSession
    folder = new_folder(spark, "perceptron")
    batches = stored_blocks(train, parts, seed, folder)
    tasks = [b.getNumPartitions() for b in batches]

    def sums_of(b: int, size: int, state) -> np.ndarray:
        return summed(batches[b], tasks[b], dims, size, _of_block, state)

    model = _trained(len(batches), sums_of, layers, alpha, rate, epochs, seed)
    released(*batches)
    dropped(spark, folder)
    return model


def _trained_on(batches, dims: int, layers: list[int], alpha: float, rate: float, epochs: int, seed: int) -> Perceptron:
    """All steps over the rows (batch, features, target) of this task."""
    parts = [(b.column("batch").to_numpy(), _vectors(b.column("features")), b.column("target").to_numpy()) for b in batches if b.num_rows]
    number, x, target = (np.concatenate(column) for column in zip(*parts))
    del parts
    order, target = np.argsort(number, kind="stable"), target.astype(np.int32)
    ends = np.flatnonzero(np.diff(number[order])) + 1
    held = [(x[own], target[own]) for own in np.split(order, ends)]
    del x

    def sums_of(b: int, size: int, state) -> np.ndarray:
        most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(dims, 1)))
        own, classes = held[b]
        return sum(_sums(own[i : i + most], classes[i : i + most], *state) for i in range(0, len(own), most))

    return _trained(len(held), sums_of, layers, alpha, rate, epochs, seed)


def _trained(batches: int, sums_of: Callable, layers: list[int], alpha: float, rate: float, epochs: int, seed: int) -> Perceptron:
    """Steps by sums_of(batch, size, (weights, shifts)), the `_sums` over a batch."""
    weights, shifts = _start(layers, seed)
    first = [np.zeros_like(p) for pair in zip(weights, shifts) for p in pair]
    second = [np.zeros_like(p) for p in first]
    size = 2 + sum(p.size for p in first)
    rng, step, losses, best, waited = np.random.default_rng(seed), 0, [], math.inf, 0
    for _ in range(epochs):
        total = seen = 0.0
        for b in rng.permutation(batches):
            sums = sums_of(b, size, (weights, shifts))
            n, loss, at = sums[0], sums[1], 2
            total += loss + 0.5 * alpha * sum(float((w * w).sum()) for w in weights)
            seen += n
            step += 1
            length = rate * math.sqrt(1 - SECOND**step) / (1 - FIRST**step)
            for i, values in enumerate(p for pair in zip(weights, shifts) for p in pair):
                slope = sums[at : at + values.size].reshape(values.shape) / n
                at += values.size
                if i % 2 == 0:
                    slope = slope + alpha * values / n
                first[i] = FIRST * first[i] + (1 - FIRST) * slope
                second[i] = SECOND * second[i] + (1 - SECOND) * slope * slope
                values -= length * first[i] / (np.sqrt(second[i]) + TINY)
        losses.append(total / seen)
        waited = waited + 1 if losses[-1] > best - TOLERANCE else 0
        best = min(best, losses[-1])
        if waited > PATIENCE:
            break
    return Perceptron(weights, shifts, losses)
