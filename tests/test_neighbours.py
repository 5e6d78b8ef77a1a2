import random

import numpy as np
import pytest

from layerlens.operators import neighbours

COLUMNS = "id long, features array<double>, label int"


def _brute(train, test, k):
    out = {}
    for i, x, _ in test:
        order = sorted(train, key=lambda r: (((np.array(r[1]) - np.array(x)) ** 2).sum(), r[0]))
        out[i] = [r[0] for r in order[:k]]
    return out


def _rows(rng, n, start, copies=0.0):
    rows = []
    for i in range(start, start + n):
        if rng.random() < copies:
            vector = [0.5, 0.5, 0.5]
        else:
            centre = rng.choice([0, 10, 20])
            vector = [centre + rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, vector, rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("chunk", [7, 2048])
def test_same_neighbours_as_brute_force(spark, monkeypatch, chunk):
    """Also when a third of all rows are copies of one vector and cells are split."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    rng = random.Random(1)
    train, test = _rows(rng, 150, 0, 0.33), _rows(rng, 40, 1000, 0.33)
    found = neighbours.nearest_neighbours(
        spark.createDataFrame(train, COLUMNS).repartition(3), spark.createDataFrame(test, COLUMNS), 4
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == _brute(train, test, 4)


def test_more_neighbours_than_rows(spark):
    train = [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 0)]
    test = [(9, [0.1, 0.0], 0)]
    rows = neighbours.nearest_neighbours(
        spark.createDataFrame(train, COLUMNS), spark.createDataFrame(test, COLUMNS), 5
    ).collect()
    assert sorted((r.neighbour, r.rank) for r in rows) == [(1, 1), (2, 2)]


def test_vote_ties_go_to_the_lowest_label(spark):
    rows = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (1, 2), (2, 5)], "id long, label int")
    assert {r.id: r.y_pred for r in neighbours.vote(rows).collect()} == {1: 2, 2: 5}


def test_empty_training_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    with pytest.raises(ValueError):
        neighbours.nearest_neighbours(empty, empty, 1)
