import random

import pytest

from layerlens.operators import guided, probes
from layerlens.session import new_folder


def _space(rng):
    return {"x": rng.uniform(0, 1), "rate": 10 ** rng.uniform(-4, 0), "kind": rng.choice(["a", "b", "c"]), "sizes": rng.choice([(1,), (2, 2)])}


def _worth(p):
    return 1 - abs(p["x"] - 0.7) + 0.3 * (p["kind"] == "b") + 0.3 * (p["rate"] > 0.05) + 0.2 * (len(p["sizes"]) == 2)


def test_proposals_beat_draws():
    """After the first trials, proposals are better than draws of the same number, over many seeds."""
    better = 0
    for seed in range(20):
        rng = random.Random(seed)
        trials = [{"trial": i, "params": p, "accuracy": _worth(p)} for i, p in enumerate(_space(rng) for _ in range(guided.STARTUP))]
        proposed = []
        for i in range(guided.STARTUP, 30):
            params = guided.propose([_space(rng) for _ in range(guided.CANDIDATES)], trials, "accuracy")
            proposed.append(_worth(params))
            trials.append({"trial": i, "params": params, "accuracy": proposed[-1]})
        drawn = [_worth(_space(rng)) for _ in range(len(proposed))]
        better += sum(proposed) > sum(drawn)
    assert better >= 18


def test_parameters_of_one_value_and_no_parameters():
    trials = [{"trial": i, "params": {"x": 1.0}, "accuracy": 0.5} for i in range(12)]
    assert guided.propose([{"x": 1.0}, {"x": 1.0}], trials, "accuracy") == {"x": 1.0}
    assert guided.propose([{}, {}], [{**t, "params": {}} for t in trials], "accuracy") == {}


def test_a_search_goes_on_where_it_stopped(spark, monkeypatch):
    monkeypatch.setattr(guided, "STARTUP", 2)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(3 * (i % 2), 1), rng.gauss(0, 1)], i % 2) for i in range(80)]
    train = spark.createDataFrame(rows, "id long, features array<double>, label int").cache()
    whole = probes.search(train, "decision-tree", trials=4, seed=3)
    folder = new_folder(spark, "trials")
    part = probes.search(train, "decision-tree", trials=3, seed=3, folder=folder)
    assert part == whole[:3]
    ran = []
    fit = probes.fit
    monkeypatch.setattr(probes, "fit", lambda *a, **k: ran.append(a[2]) or fit(*a, **k))
    again = probes.search(train, "decision-tree", trials=4, seed=3, folder=folder)
    assert [t["params"] for t in again] == [t["params"] for t in whole]
    assert [t["accuracy"] for t in again] == pytest.approx([t["accuracy"] for t in whole])
    assert ran == [whole[3]["params"]]
    assert len(probes.search(train, "decision-tree", trials=2, seed=4, folder=folder)) == 2
