import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.operators import probes
from layerlens.plans import jobs, probe_queries
from layerlens.session import new_folder

COLUMNS = "id long, features array<double>, label int"
PARAMS = {
    "logistic-regression": {"C": 1.0},
    "linear-svm": {"C": 1.0},
    "mlp": {"hidden_layer_sizes": (8,), "learning_rate_init": 0.05, "max_iter": 60},
    "non-linear-svm": {"C": 10.0, "kernel": "rbf"},
    "decision-tree": {"max_depth": 4},
    "random-forest": {"n_estimators": 10, "max_depth": 4},
    "xgboost": {"n_estimators": 3, "learning_rate": 0.3},
    "lightgbm": {"n_estimators": 3, "learning_rate": 0.3, "num_leaves": 31},
    "naive-bayes-gaussian": {},
    "knn": {"n_neighbors": 3},
}


def _rows(n, classes, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.randrange(classes)
        rows.append((i, [rng.gauss(3 * (label == d), 1) for d in range(3)], label))
    return rows


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(_rows(160, 2, 1), COLUMNS).cache()


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(_rows(160, 3, 2), COLUMNS).cache()


def _hits(fitted, df):
    joined = fitted.predict(df).join(df.select("id", "label"), "id")
    return joined.agg(F.avg((F.col("y_pred") == F.col("label")).cast("int"))).first()[0]


@pytest.mark.parametrize("probe", probes.PROBES)
def test_every_probe_learns_two_classes(two, probe):
    assert _hits(probes.fit(two, probe, PARAMS[probe]), two) > 0.85


@pytest.mark.parametrize("probe", ["linear-svm", "non-linear-svm", "xgboost", "logistic-regression"])
def test_more_than_two_classes(three, probe):
    assert _hits(probes.fit(three, probe, PARAMS[probe]), three) > 0.75


@pytest.mark.parametrize("probe", probes.PROBES)
def test_labels_need_not_be_numbered(spark, two, probe):
    """Labels 0 and 5 give two classes and come back as 0 and 5, from a saved probe too."""
    apart = two.withColumn("label", F.col("label") * 5)
    assert probes.facts(apart).classes == 2
    fitted = probes.fit(apart, probe, PARAMS[probe])
    folder = new_folder(spark, "probe")
    fitted.save(folder, spark)
    assert _hits(probes.FittedProbe.load(folder, spark), apart) > 0.85


@pytest.mark.parametrize("probe", ["non-linear-svm", "knn", "logistic-regression"])
def test_saved_probe_predicts_the_same(spark, two, probe):
    fitted = probes.fit(two, probe, PARAMS[probe])
    folder = new_folder(spark, "probe")
    fitted.save(folder, spark)
    loaded = probes.FittedProbe.load(folder, spark)
    one, other = (sorted(map(tuple, p.predict(two).collect())) for p in (fitted, loaded))
    assert one == other and loaded.probe == probe


def test_penalty_matches_a_direct_solution(two):
    """Half the squared weights plus C times the summed loss, solved by Newton steps."""
    rows = two.collect()
    x = np.array([[*r.features, 1.0] for r in rows])
    y = np.array([r.label for r in rows])
    c, w = 0.05, np.zeros(4)
    weight = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        slope = weight @ w + c * x.T @ (p - y)
        w -= np.linalg.solve(weight + c * (x * (p * (1 - p))[:, None]).T @ x, slope)
    model = probes.fit(two, "logistic-regression", {"C": c}).model.stages[-1]
    assert model.coefficients.toArray() == pytest.approx(w[:3], abs=0.02)
    assert model.intercept == pytest.approx(w[3], abs=0.02)


def test_unknown_probe(two):
    with pytest.raises(ValueError):
        probes.fit(two, "perceptron", {})
    with pytest.raises(ValueError):
        probes.search(two, "perceptron")


def test_search_repeats_and_first_wins_ties(spark, two):
    first, again = (probes.search(two, "decision-tree", trials=3, seed=5) for _ in range(2))
    assert first == again and [t["trial"] for t in first] == [0, 1, 2]
    tied = [{"trial": i, "accuracy": 0.5} for i in range(3)]
    assert probes.best_trial(tied)["trial"] == 0
    table = probes.trial_table(spark, first)
    best = probes.best_of_trials(table, ["probe"], "accuracy", ["trial"]).first()
    assert best.trial == probes.best_trial(first)["trial"]


def test_draws_stay_in_their_ranges(two):
    table = probes.facts(two)
    assert (table.rows, table.classes, table.dims) == (160, 2, 3)
    for params in probes.draw_params(probes.SPACES, "random-forest", table, 50, 1):
        assert 50 <= params["n_estimators"] <= 200 and 3 <= params["max_depth"] <= 30
    for params in probes.draw_params(probes.FROZEN_SPACES, "lightgbm", table, 50, 1):
        assert params["num_leaves"] in (31, 41, 51, 61)
        assert params["n_estimators"] in (100, 200, 300)


def test_grid_goes_on_after_a_failure(spark, two):
    features = two.select(
        F.lit(0).alias("layer"),
        F.lit("mean").alias("pooling"),
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"),
        "id",
        "features",
        "label",
    )
    cells = [(0, "mean", "no-such-probe"), (0, "mean", "naive-bayes-gaussian")]
    folder = new_folder(spark, "grid")
    rows = {r.probe: r for r in probes.run_grid(features, cells, folder, trials=1).collect()}
    assert rows["no-such-probe"].status == "failed" and "Unknown" in rows["no-such-probe"].error
    done = rows["naive-bayes-gaussian"]
    assert done.status == "done" and done.accuracy > 0.8
    stored = spark.read.parquet(folder)
    assert stored.select("probe").distinct().count() == 1 and stored.count() == 40


def test_frozen_comparison_keeps_the_best(spark, two):
    spaces = {
        "logistic-regression": probes.FROZEN_SPACES["logistic-regression"],
        "non-linear-svm": lambda rng, f: {"C": 1.0, "kernel": "linear"},
    }
    winner, preds, trials = probes.compare_frozen(two, two, trials=2, spaces=spaces)
    rows = trials.collect()
    assert len(rows) == 4 and preds.count() == 160
    assert winner.probe == max(rows, key=lambda r: r.f1_score).probe


def test_scoring_run_counts_rows(two):
    row = jobs.scoring_run(two).first()
    assert row.rows == 160 and row.seconds > 0
    assert row.rows_per_second == pytest.approx(160 / row.seconds)
    empty = jobs.scoring_run(two.filter("id < 0")).first()
    assert empty.rows == 0 and empty.seconds_per_row != empty.seconds_per_row


@pytest.mark.parametrize("probe", ["logistic-regression", "linear-svm", "non-linear-svm"])
def test_fits_after_a_scoring_run(two, probe):
    jobs.scoring_run(two)
    params = {"C": 1.0, "kernel": "linear"}
    assert probes.fit(two, probe, params).predict(two).count() == two.count()


def test_grid_scores_all_cells_in_one_pass(spark, two, three, monkeypatch):
    """Two parts of two and three classes: as searched and scored one by one, in few passes."""
    def part(df, layer):
        split = F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split")
        return df.select(F.lit(layer).alias("layer"), F.lit("mean").alias("pooling"), split, "id", "features", "label")

    features = part(two, 0).unionAll(part(three, 1)).cache()
    cells = [(layer, "mean", probe) for layer in (0, 1) for probe in ("decision-tree", "naive-bayes-gaussian", "knn")]
    aligned, align = [], probes.metrics.align
    monkeypatch.setattr(probes.metrics, "align", lambda *args: aligned.append(args) or align(*args))
    rows = probes.run_grid(features, cells, new_folder(spark, "grid"), trials=2, seed=3).collect()
    assert len(aligned) == 2
    monkeypatch.undo()
    assert [(r.layer, r.pooling, r.probe) for r in rows] == cells
    for row in rows:
        mine = features.filter(F.col("layer") == row.layer)
        train, test = mine.filter("split = 'train'"), mine.filter("split = 'test'")
        fitted, _ = probes.search_and_refit(train, row.probe, 2, 3)
        pairs = align(fitted.predict(test), test.select("id", "label"), ["id"])
        classes = probes.metrics.class_scores(probes.metrics.confusion(pairs, []), [])
        expected = probes.metrics.scores(classes, [], "macro" if row.layer else "binary").first()
        assert row.status == "done" and row.params == {k: str(v) for k, v in fitted.params.items()}
        assert [row[m] for m in probes.metrics.METRICS] == pytest.approx([expected[m] for m in probes.metrics.METRICS])


def test_grid_part_of_mixed_lengths_fails_alone(spark, two):
    split = F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split")
    good = two.select(F.lit(0).alias("layer"), F.lit("mean").alias("pooling"), split, "id", "features", "label")
    longer = F.when(F.col("id") % 3 == 0, F.concat("features", "features")).otherwise(F.col("features"))
    bad = good.withColumn("layer", F.lit(1)).withColumn("features", longer)
    cells = [(layer, "mean", "naive-bayes-gaussian") for layer in (0, 1, 2)]
    rows = probes.run_grid(good.unionAll(bad), cells, new_folder(spark, "grid"), trials=1).collect()
    assert [r.status for r in rows] == ["done", "failed", "failed"]


def test_registered_comparison_runs_five_trials_of_each(spark, tmp_path, monkeypatch):
    rng, searched = random.Random(4), []
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def cheap(train, probe, trials, *args):
        searched.append((probe, trials))
        return [{"trial": i, "probe": "logistic-regression", "params": {"C": 10.0}, "accuracy": 1.0, "f1_score": 1.0} for i in range(trials)]

    monkeypatch.setattr(probes, "search", cheap)
    (row,) = probe_queries.frozen_comparison(spark, str(tmp_path)).collect()
    assert sorted(searched) == sorted((probe, 5) for probe in probes.FROZEN_SPACES)
    assert row.f1_score == pytest.approx(1.0)
