import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.operators import calibration, probes
from layerlens.session import new_folder

COLUMNS = "id long, features array<double>, label int"


def _plain(f, t):
    """Plain Newton steps for one class."""
    a, b = 0.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * f + b)))
        w = p * (1 - p)
        h = np.array([[(w * f * f).sum(), (w * f).sum()], [(w * f).sum(), w.sum()]])
        step = np.linalg.solve(h, [((p - t) * f).sum(), (p - t).sum()])
        size = 1.0
        loss = lambda a, b: (np.logaddexp(0, a * f + b) - t * (a * f + b)).sum()
        while loss(a - size * step[0], b - size * step[1]) > loss(a, b) and size > 1e-9:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
    return a, b


@pytest.mark.parametrize("classes", [2, 3])
def test_equals_plain_newton_steps(spark, classes):
    rng = np.random.default_rng(classes)
    y = rng.integers(0, classes, 120)
    f = rng.normal(size=(120, classes))
    f[np.arange(120), y] += 1
    rows = [(i, list(map(float, s)), int(c)) for i, (s, c) in enumerate(zip(f, y))]
    counts = np.bincount(y, minlength=classes).tolist()
    a, b = calibration.fit(spark.createDataFrame(rows, "id long, features array<double>, target int"), classes, counts)
    for column, k in enumerate([1] if classes == 2 else range(classes)):
        t = np.where(y == k, (counts[k] + 1) / (counts[k] + 2), 1 / (120 - counts[k] + 2))
        assert (a[column], b[column]) == pytest.approx(_plain(f[:, k], t), abs=1e-4)


@pytest.mark.parametrize("probe, params", [("non-linear-svm", {"C": 1.0, "kernel": "rbf"}), ("linear-svm", {"C": 1.0})])
def test_probabilities_of_a_probe(spark, probe, params):
    """They sum to 1, lean to the right class, tell more than even chances, and are kept when saved."""
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 3))
    x[np.arange(240), y] += 2
    rows = spark.createDataFrame([(i, list(map(float, v)), int(c) * 4) for i, (v, c) in enumerate(zip(x, y))], COLUMNS).cache()
    fitted = probes.fit(rows, probe, {**params, "probability": True})
    found = fitted.probabilities(rows).join(rows.select("id", "label"), "id").collect()
    chance = [r.probabilities[r.label // 4] for r in found]
    assert all(sum(r.probabilities) == pytest.approx(1) for r in found)
    assert -np.log(chance).mean() < 0.8 * np.log(3)
    folder = new_folder(spark, "probe")
    fitted.save(folder, spark)
    again = probes.FittedProbe.load(folder, spark)
    assert sorted(map(tuple, again.predict(rows).collect())) == sorted(map(tuple, fitted.predict(rows).collect()))
    assert {r.id: r.probabilities for r in again.probabilities(rows).collect()} == {r.id: r.probabilities for r in found}
    plain = probes.fit(rows, probe, params)
    assert plain.probabilities(rows).where(F.col("probabilities").isNotNull()).isEmpty()
