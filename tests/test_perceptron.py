import numpy as np
import pytest
from pyspark import RDD

from layerlens.operators import perceptron

ROWS = "id long, features array<double>, target int"


def _data(n, classes, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 3))
    x[np.arange(n), y % 3] += 2
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))], ROWS)


def _loss(x, y, weights, shifts, alpha):
    p = perceptron._forward(x, weights, shifts)[-1]
    hit = np.where(y == 1, p[:, 0], 1 - p[:, 0]) if p.shape[1] == 1 else p[np.arange(len(y)), y]
    return (-np.log(hit).sum() + 0.5 * alpha * sum((w * w).sum() for w in weights)) / len(y)


@pytest.mark.parametrize("classes", [2, 3])
def test_gradients_by_differences(classes):
    x, y = _data(20, classes, 1)
    weights, shifts = perceptron._start([3, 4, 5, 1 if classes == 2 else classes], 7)
    sums = perceptron._sums(x, y, weights, shifts)
    assert sums[0] == 20 and sums[1] / 20 == pytest.approx(_loss(x, y, weights, shifts, 0))
    at = 2
    for w, b in zip(weights, shifts):
        for values in (w, b):
            got = sums[at : at + values.size].reshape(values.shape)
            at += values.size
            for place in np.ndindex(values.shape):
                keep = values[place]
                values[place] = keep + 1e-6
                up = _loss(x, y, weights, shifts, 0)
                values[place] = keep - 1e-6
                down = _loss(x, y, weights, shifts, 0)
                values[place] = keep
                assert got[place] / 20 == pytest.approx((up - down) / 2e-6, abs=1e-5)


def _plain(x, y, hidden, alpha, rate, epochs, seed):
    """The same steps over all rows as one batch."""
    weights, shifts = perceptron._start([x.shape[1], *hidden, 1 if y.max() < 2 else int(y.max()) + 1], seed)
    params = [p for pair in zip(weights, shifts) for p in pair]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        sums, at = perceptron._sums(x, y, weights, shifts), 2
        for i, p in enumerate(params):
            g = sums[at : at + p.size].reshape(p.shape) / len(x) + (alpha * p / len(x) if p.ndim == 2 else 0)
            at += p.size
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    return weights


@pytest.mark.parametrize("direct", [0, 64])
def test_same_weights_as_plain_steps(spark, monkeypatch, direct):
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 11)
    monkeypatch.setattr(perceptron, "DIRECT_TASKS", direct)
    x, y = _data(90, 3, 2)
    model = perceptron.fit(_frame(spark, x, y).repartition(3), 90, 3, 3, (4,), 0.5, 0.01, 6, 5)
    for got, want in zip(model.weights, _plain(x, y, (4,), 0.5, 0.01, 6, 5)):
        assert np.allclose(got, want, atol=1e-6)


def test_every_parameter_changes_the_fit(spark):
    x, y = _data(60, 2, 3)
    rows = _frame(spark, x, y).cache()
    base = dict(hidden=(4,), alpha=1e-4, rate=1e-2, epochs=4, seed=1)
    first = perceptron.fit(rows, 60, 3, 2, **base).probabilities(x)
    for change in ({"hidden": (5,)}, {"alpha": 5.0}, {"rate": 1e-3}, {"epochs": 8}, {"seed": 2}):
        assert not np.allclose(perceptron.fit(rows, 60, 3, 2, **(base | change)).probabilities(x), first)


def test_batches_learn_and_stop(spark, monkeypatch):
    monkeypatch.setattr(perceptron, "BATCH_ROWS", 50)
    x, y = _data(150, 3, 4)
    model = perceptron.fit(_frame(spark, x, y), 150, 3, 3, (8,), rate=0.05, epochs=60)
    assert (model.probabilities(x).argmax(axis=1) == y).mean() > 0.8
    assert model.losses[-1] < model.losses[0]
    again = perceptron.Perceptron.from_json(model.to_json())
    assert np.array_equal(again.probabilities(x), model.probabilities(x))


def test_few_sums_reach_the_driver(spark, monkeypatch):
    """Many tasks' gradients are added up before the driver gets them."""
    monkeypatch.setattr(perceptron, "TASK_NUMBERS", 1)
    seen, collect = [], RDD.collect

    def counted(rdd):
        seen.append(collect(rdd))
        return seen[-1]

    monkeypatch.setattr(RDD, "collect", counted)
    x, y = _data(90, 3, 2)
    model = perceptron.fit(_frame(spark, x, y).repartition(12), 90, 3, 3, (4,), 0.5, 0.01, 2, 5)
    assert seen and max(map(len, seen)) <= perceptron.DIRECT_TASKS
    for got, want in zip(model.weights, _plain(x, y, (4,), 0.5, 0.01, 2, 5)):
        assert np.allclose(got, want, atol=1e-6)


def test_blocks_hold_few_numbers(spark, monkeypatch, tmp_path):
    """Wide rows come in shorter blocks, so that a task's memory does not follow their width."""
    monkeypatch.setattr(perceptron, "BLOCK_NUMBERS", 30, raising=False)
    x, y = _data(90, 3, 2)
    (blocks,) = perceptron.stored_blocks(_frame(spark, x, y), 1, 5, f"{tmp_path}/blocks")
    held = [(np.frombuffer(a).reshape(-1, 3), np.frombuffer(b, np.int32)) for a, b in blocks.collect()]
    assert max(a.size for a, _ in held) <= 30
    rows = sorted((*map(float, v), int(c)) for a, b in held for v, c in zip(a, b))
    assert rows == sorted((*map(float, v), int(c)) for v, c in zip(x, y))


def test_gathered_and_dealt_rows_give_the_same(spark, monkeypatch):
    """Batches of one task take the steps that jobs take."""
    monkeypatch.setattr(perceptron, "BATCH_ROWS", 20)
    x, y = _data(150, 3, 6)
    rows = _frame(spark, x, y).repartition(3).cache()
    models = []
    for tasks in (perceptron.GATHERED_TASKS, 0):
        monkeypatch.setattr(perceptron, "GATHERED_TASKS", tasks)
        models.append(perceptron.fit(rows, 150, 3, 3, (5, 4), 0.1, 0.01, 3, 5))
    one, other = models
    assert np.allclose(one.losses, other.losses) and len(one.losses) == 3
    for a, b in zip(one.weights + one.shifts, other.weights + other.shifts):
        assert np.allclose(a, b, atol=1e-8)
    wide = perceptron.GATHERED_TASKS * perceptron.TASK_NUMBERS + 1
    assert not perceptron.gathered(wide)


def test_steps_of_a_small_table_are_no_jobs(spark):
    x, y = _data(60, 3, 8)
    rows = _frame(spark, x, y).cache()
    spark.sparkContext.setJobGroup("steps", "")
    perceptron.fit(rows, 60, 3, 3, (4,), rate=1e-4, epochs=60)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps")) < 10
