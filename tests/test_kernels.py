import numpy as np
import pytest

from layerlens.operators import kernels

ROWS = "id long, features array<double>, target int"


def _rings(n, classes, seed):
    """Classes by distance from the origin: no line parts them."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    angle = rng.uniform(0, 2 * np.pi, n)
    radius = 0.3 + y + rng.uniform(0, 0.4, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), y


def _frame(spark, x, y):
    return spark.createDataFrame([(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))], ROWS)


def test_kernels_by_their_formulas():
    x, y = np.array([[1.0, 2.0]]), np.array([[0.5, -1.0]])
    got = {k: kernels.kernel_matrix(k, 0.7, x, y)[0, 0] for k in ("linear", "rbf", "poly", "sigmoid")}
    assert got == pytest.approx({
        "linear": -1.5, "rbf": np.exp(-0.7 * 9.25), "poly": (0.7 * -1.5) ** 3, "sigmoid": np.tanh(0.7 * -1.5),
    })
    with pytest.raises(ValueError):
        kernels.kernel_matrix("cosine", 1.0, x, y)


@pytest.mark.parametrize("classes", [2, 3])
def test_rings_are_told_apart(spark, classes):
    x, y = _rings(200, classes, 1)
    model = kernels.fit(_frame(spark, x, y), 2, classes, 10.0, "rbf", 1.0)
    assert (model.scores(x).argmax(axis=1) == y).mean() > 0.97
    again = kernels.KernelMargins.from_json(model.to_json())
    assert np.array_equal(again.scores(x), model.scores(x))


@pytest.mark.parametrize("kernel", ["linear", "poly", "sigmoid"])
def test_other_kernels_part_half_planes(spark, kernel):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] > 0).astype(int)
    model = kernels.fit(_frame(spark, x, y), 3, 2, 10.0, kernel, 0.3)
    assert (model.scores(x).argmax(axis=1) == y).mean() > 0.9


def test_products_of_mapped_landmarks_are_the_kernel(spark, monkeypatch):
    """Exactly for a kernel with a map, and the error falls with more landmarks."""
    x, y = _rings(120, 2, 2)
    rows = _frame(spark, x, y)
    errors = []
    for n in (4, 40):
        monkeypatch.setattr(kernels, "LANDMARKS", n)
        model = kernels.landmark_map(rows, "rbf", 0.5)
        near = model.mapped(model.landmarks)
        assert np.allclose(near @ near.T, kernels.kernel_matrix("rbf", 0.5, model.landmarks, model.landmarks), atol=1e-6)
        errors.append(model.error)
    assert errors[1] < errors[0] and errors[1] < 0.01
