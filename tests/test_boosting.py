import numpy as np
import pytest

from layerlens.operators import boosting, perceptron
from layerlens.operators.boosting import Growth

ROWS = "features array<double>, target int"


def _data(n, dims, classes, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).round(3)
    score = np.stack([x[:, c % dims] + 0.5 * x[:, (c + 1) % dims] ** 2 for c in range(classes)], axis=1)
    return x, (score + rng.normal(size=score.shape)).argmax(axis=1)


def plain(x, y, classes, cuts, growth):
    """The margins of strict growth, one split at a time, every histogram counted anew."""
    bins = boosting.binned(x, cuts).astype(int)
    k = 1 if classes == 2 else classes
    margins = np.zeros((len(x), k))
    for _ in range(growth.rounds):
        g, h = boosting._slopes(margins, y, growth.wide)
        step = np.zeros_like(margins)
        for c in range(k):
            leaves = [(np.arange(len(x)), 0)]
            while not growth.num_leaves or len(leaves) < growth.num_leaves:
                best = None
                for at, (rows, depth) in enumerate(leaves):
                    if growth.max_depth and depth >= growth.max_depth:
                        continue
                    total = g[rows, c].sum() ** 2 / max(h[rows, c].sum() + growth.penalty, 1e-16)
                    for d in range(x.shape[1]):
                        for b in range(len(cuts[d])):
                            left = bins[rows, d] <= b
                            a, z = rows[left], rows[~left]
                            if min(len(a), len(z)) < max(growth.min_rows, 1):
                                continue
                            ha, hz = h[a, c].sum(), h[z, c].sum()
                            if min(ha, hz) < growth.min_curvature:
                                continue
                            gain = g[a, c].sum() ** 2 / (ha + growth.penalty) + g[z, c].sum() ** 2 / (hz + growth.penalty) - total
                            gain = round(gain, boosting.DIGITS)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = gain, at, a, z, depth
                if best is None:
                    break
                _, at, a, z, depth = best
                leaves[at : at + 1] = [(a, depth + 1), (z, depth + 1)]
            for rows, _ in leaves:
                step[rows, c] = -growth.rate * g[rows, c].sum() / max(h[rows, c].sum() + growth.penalty, 1e-16)
        margins += step
    return margins


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("growth", [
    Growth(3, 0.3, max_depth=3),
    Growth(3, 0.3, num_leaves=6, penalty=0.0, min_curvature=1e-3, min_rows=5, wide=True),
])
def test_same_margins_as_plain_growth(spark, monkeypatch, classes, growth):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 37)
    monkeypatch.setattr(boosting, "STORE_ROUNDS", 2)
    x, y = _data(240, 4, classes, 3)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], ROWS).repartition(3)
    model = boosting.fit(rows, classes, growth)
    assert np.allclose(model.margins(x), plain(x, y, classes, model.cuts, growth), atol=1e-8)
    again = boosting.BoostedTrees.from_json(model.to_json())
    assert np.array_equal(again.margins(x), model.margins(x))
    assert np.allclose(model.probabilities(x).sum(axis=1), 1)


@pytest.mark.parametrize("leaves", [2, 5, 9])
def test_number_of_leaves(spark, leaves):
    x, y = _data(400, 3, 2, 5)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], ROWS)
    model = boosting.fit(rows, 2, Growth.by_leaves({"n_estimators": 2, "learning_rate": 0.1, "num_leaves": leaves}))
    for (tree,) in model.rounds:
        assert (np.isin(np.arange(len(tree.value)), tree.leaves(boosting.binned(x, model.cuts)))).sum() == leaves


def test_one_class_and_equal_rows(spark):
    """Nothing can be split; the margins still fall toward the one class."""
    rows = spark.createDataFrame([([1.0, 2.0], 0)] * 5, ROWS)
    model = boosting.fit(rows, 1, Growth(3, 0.3, max_depth=2))
    assert (model.probabilities(np.array([[1.0, 2.0]])).argmax(axis=1) == 0).all()


def test_a_pass_is_one_small_job(spark):
    """No pass writes a table or reads one back, and margins take one job a round."""
    x, y = _data(60, 3, 2, 9)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], ROWS).coalesce(1)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    spark.sparkContext.setJobGroup("boosted", "")
    counts = []
    for rounds in (1, 4):
        before = jobs()
        boosting.fit(rows, 2, Growth(rounds, 0.3, max_depth=2))
        counts.append(jobs() - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] - counts[0] <= 3 * 4  # three passes and the margins


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("growth", [
    Growth(4, 0.3, max_depth=3),
    Growth(4, 0.3, num_leaves=6, penalty=0.0, min_curvature=1e-3, min_rows=5, wide=True),
])
def test_gathered_and_dealt_rows_give_the_same(spark, monkeypatch, classes, growth):
    """Trees of one task are those that passes over many blocks give."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 37)
    monkeypatch.setattr(boosting, "PIECE_ROWS", 50)
    monkeypatch.setattr(boosting, "STORE_ROUNDS", 2)
    x, y = _data(240, 4, classes, 3)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], ROWS).repartition(3).cache()
    models = []
    for tasks in (perceptron.GATHERED_TASKS, 0):
        monkeypatch.setattr(perceptron, "GATHERED_TASKS", tasks)
        models.append(boosting.fit(rows, classes, growth, from_prior=True))
    one, other = models
    assert len(one.rounds) == len(other.rounds) == 4
    assert np.allclose(one.margins(x), other.margins(x), atol=1e-8)


def test_rounds_of_a_small_table_are_no_jobs(spark):
    x, y = _data(60, 3, 3, 9)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], ROWS).coalesce(1).cache()
    spark.sparkContext.setJobGroup("rounds", "")
    boosting.fit(rows, 3, Growth(30, 0.1, max_depth=2))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 20
