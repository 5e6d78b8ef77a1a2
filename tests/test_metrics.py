import math
import random

import pytest

from layerlens.operators import compare, metrics

PREDS = "dataset string, probe string, id long, y_pred int"
TRUTH = "dataset string, id long, label int"
KEYS = ["dataset", "probe"]


def _scores(pairs, average):
    labels = sorted({x for p in pairs for x in p})
    rows = []
    for c in labels:
        hit = sum(t == p == c for t, p in pairs)
        said, real = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        rows.append((c, real, said, hit / said if said else 0, hit / real if real else 0,
                     2 * hit / (said + real) if said + real else 0))
    n = len(pairs)
    weights = {
        "macro": [1 / len(rows)] * len(rows),
        "weighted": [r[1] / n for r in rows],
        "binary": [float(r[0] == 1) for r in rows],
    }[average]
    means = [sum(w * r[i] for w, r in zip(weights, rows)) for i in (3, 4, 5)]
    right = sum(t == p for t, p in pairs)
    over = right * n - sum(r[1] * r[2] for r in rows)
    under = (n * n - sum(r[2] ** 2 for r in rows)) * (n * n - sum(r[1] ** 2 for r in rows))
    return [right / n, *means, over / math.sqrt(under) if under else 0.0]


@pytest.mark.parametrize("average", ["binary", "macro", "weighted"])
def test_scores_match_definitions(spark, average):
    rng = random.Random(3)
    truth = [("d", i, rng.randint(0, 3)) for i in range(200)]
    preds = [("d", p, i, t if rng.random() < 0.6 else rng.randint(-1, 4))
             for p in ("a", "b") for _, i, t in truth]
    got = metrics.evaluate(
        spark.createDataFrame(preds, PREDS), spark.createDataFrame(truth, TRUTH),
        ["dataset", "id"], KEYS, average,
    ).collect()
    for row in got:
        pairs = [(truth[i][2], y) for _, p, i, y in preds if p == row.probe]
        want = _scores(pairs, average)
        assert [row[m] for m in metrics.METRICS] == pytest.approx(want)
        assert -1 <= row.mcc <= 1


def test_constant_sides_give_zero(spark):
    truth = spark.createDataFrame([("d", i, 0) for i in range(4)], TRUTH)
    preds = spark.createDataFrame([("d", "a", i, 0) for i in range(4)], PREDS)
    row = metrics.evaluate(preds, truth, ["dataset", "id"], KEYS).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score, row.mcc) == (1, 0, 0, 0, 0)


def test_rows_without_truth_are_left_out(spark):
    truth = spark.createDataFrame([("d", 1, 1)], TRUTH)
    preds = spark.createDataFrame([("d", "a", 1, 1), ("d", "a", 2, 0)], PREDS)
    assert metrics.evaluate(preds, truth, ["dataset", "id"], KEYS).first().accuracy == 1.0


def test_unknown_average(spark):
    truth = spark.createDataFrame([("d", 1, 1)], TRUTH)
    preds = spark.createDataFrame([("d", "a", 1, 1)], PREDS)
    with pytest.raises(ValueError):
        metrics.evaluate(preds, truth, ["dataset", "id"], KEYS, "micro")


def test_accuracy_is_trace_over_total(spark):
    truth = spark.createDataFrame([("d", i, i % 3) for i in range(30)], TRUTH)
    preds = spark.createDataFrame([("d", "a", i, (i // 2) % 3) for i in range(30)], PREDS)
    aligned = metrics.align(preds, truth, ["dataset", "id"])
    matrix = metrics.confusion_matrix(metrics.confusion(aligned, KEYS), KEYS)
    cells = matrix.collect()
    assert len(cells) == 9 and sum(c.n for c in cells) == 30
    trace = sum(c.n for c in cells if c.y_true == c.y_pred)
    assert metrics.accuracy(aligned, KEYS).first().accuracy == pytest.approx(trace / 30)
    flat = metrics.flatten_confusion(matrix, KEYS).first().confusion_matrix
    ordered = sorted(cells, key=lambda c: (c.y_true, c.y_pred))
    assert flat == ",".join(str(c.n) for c in ordered)


def test_best_breaks_ties_by_lowest(spark):
    rows = [("m", 2, "b", 0.9), ("m", 1, "z", 0.9), ("m", 1, "c", 0.9), ("m", 0, "a", 0.1)]
    df = spark.createDataFrame(rows, "pooling string, layer int, probe string, accuracy double")
    row = compare.best(df, ["pooling"], "accuracy", ["layer", "probe"]).first()
    assert (row.accuracy, row.layer, row.probe) == (0.9, 1, "c")


def test_interval_holds_the_mean_and_repeats(spark):
    rows = [(layer, f"p{i}", i / 10 + layer / 100) for layer in (0, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "layer int, probe string, accuracy double")
    first = compare.interaction(df, ["layer"], "probe").orderBy("layer").collect()
    again = compare.interaction(df.repartition(5), ["layer"], "probe").orderBy("layer").collect()
    for a, b in zip(first, again):
        assert a.ci_low < a.accuracy < a.ci_high
        assert (a.ci_low, a.ci_high) == pytest.approx((b.ci_low, b.ci_high))


def test_predictions_are_not_sorted(spark):
    """Of both sides of a scoring only the truth is held; predictions with no match stay out."""
    preds = spark.createDataFrame([(i % 5, p, i % 2) for i in range(20) for p in "ab"], "id long, probe string, y_pred int")
    truth = spark.createDataFrame([(i, 1) for i in range(4)], "id long, label int")
    found = metrics.align(preds, truth, ["id"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.count() == 32 and {r.y_true for r in found.collect()} == {1}
