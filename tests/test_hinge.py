import numpy as np
import pytest

from layerlens.operators import hinge, perceptron

ROWS = "id long, features array<double>, target int"


def _plain(x, y, c):
    """Newton steps with the whole matrix, for one class against the rest."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    value = lambda w: 0.5 * w @ w + c * (np.maximum(1 - y * (x @ w), 0) ** 2).sum()
    for _ in range(200):
        short = y * (x @ w) < 1
        slope = w - 2 * c * x[short].T @ (y[short] * (1 - y[short] * (x[short] @ w)))
        way = -np.linalg.solve(np.eye(len(w)) + 2 * c * x[short].T @ x[short], slope)
        t = 1.0
        while value(w + t * way) > value(w) + 1e-4 * t * (slope @ way) and t > 1e-12:
            t /= 2
        w = w + t * way
    return w


@pytest.mark.parametrize("classes, c, numbers", [(2, 1e-3, 10**6), (2, 50.0, 10**6), (3, 1.0, 10**6), (3, 0.01, 0)])
def test_equals_a_plain_solver(spark, monkeypatch, classes, c, numbers):
    """With the matrices summed, and with products alone."""
    monkeypatch.setattr(hinge, "TOLERANCE", 1e-7)
    monkeypatch.setattr(hinge, "MATRIX_NUMBERS", numbers)
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(classes)
    y = rng.integers(0, classes, 150)
    x = rng.normal(size=(150, 4))
    x[np.arange(150), y] += 1
    rows = [(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    model = hinge.fit(spark.createDataFrame(rows, ROWS).repartition(2), 4, classes, c)
    for column, k in enumerate([1] if classes == 2 else range(classes)):
        assert np.allclose(model.weights[:, column], _plain(x, np.where(y == k, 1.0, -1.0), c), atol=1e-5)
    again = hinge.LinearMargins.from_json(model.to_json())
    assert np.array_equal(again.scores(x), model.scores(x))


def test_gathered_and_dealt_rows_give_the_same(spark, monkeypatch):
    """In one task, whose steps are no jobs, and by a job for each sum."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 4))
    x[np.arange(150), y] += 1
    rows = spark.createDataFrame([(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))], ROWS).repartition(2).cache()
    weights, jobs = [], []
    for name, tasks in (("one", perceptron.GATHERED_TASKS), ("many", 0)):
        monkeypatch.setattr(perceptron, "GATHERED_TASKS", tasks)
        monkeypatch.setattr(perceptron, "TASK_NUMBERS", 200)
        spark.sparkContext.setJobGroup(name, "")
        weights.append(hinge.fit(rows, 4, 3, 1.0).weights)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(*weights, atol=1e-6)
    assert jobs[0] < 12 < jobs[1]
