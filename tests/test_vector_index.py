import random

import numpy as np
import pytest

from layerlens.operators import neighbours, vector_index
from layerlens.operators.vector_index import VectorIndex
from layerlens.session import new_folder

COLUMNS = "id long, features array<double>, label int"


def _rows(n, start, seed, dims=16, groups=12):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dims)) * 3
    which = rng.integers(0, groups, n)
    x = centres[which] + rng.normal(size=(n, dims))
    return [(start + i, list(map(float, v)), int(c)) for i, (v, c) in enumerate(zip(x, which))]


@pytest.fixture(scope="module")
def index(spark):
    train = spark.createDataFrame(_rows(3000, 0, 1), COLUMNS).cache()
    return train, VectorIndex.build(train, new_folder(spark, "index"), list_rows=50)


def test_recall(spark, index):
    train, built = index
    test = spark.createDataFrame(_rows(200, 10_000, 2), COLUMNS)
    assert len(built.lists) > 20
    found = built.search(test, 10)
    row = vector_index.recall(found, neighbours.nearest_neighbours(train, test, 10)).first()
    assert (row.tests, row.k) == (200, 10) and row.recall >= 0.9
    for r in found.collect():
        assert 1 <= r.rank <= 10


def test_every_list_visited_is_exact(spark, index):
    """With all lists probed and all rows compared, the index gives what the exact way gives."""
    train, built = index
    test = spark.createDataFrame(_rows(20, 10_000, 3), COLUMNS)
    found = built.search(test, 5, probes=len(built.lists), candidates=3000)
    exact = neighbours.nearest_neighbours(train, test, 5)
    key = ["id", "neighbour", "label", "rank"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, exact.select(key).collect()))


def test_loaded_index_answers_the_same(spark, index):
    _, built = index
    test = spark.createDataFrame(_rows(30, 10_000, 4), COLUMNS)
    again = VectorIndex.load(spark, built.folder)
    one, two = (sorted(map(tuple, i.search(test, 3).collect())) for i in (built, again))
    assert one == two
    assert {r.id for r in again.classify(test, 3).collect()} == set(range(10_000, 10_030))


def test_every_row_is_stored_and_copies_share_an_entry(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [rng.random(), rng.random()], i % 2) for i in range(300)]
    train = spark.createDataFrame(rows, COLUMNS).repartition(5)
    built = VectorIndex.build(train, new_folder(spark, "index"), list_rows=20)
    assert sum(built.lists.values()) == built.entries.count() == built.vectors.count() == 201
    test = spark.createDataFrame([(1000, [1.0, 2.0], 0), (1001, [0.99, 2.0], 0)], COLUMNS)
    found = built.search(test, 4).collect()
    for i in (1000, 1001):
        assert [r.neighbour for r in sorted(found, key=lambda r: r.rank) if r.id == i] == [0, 3, 6, 9]


def test_few_rows_and_bad_calls(spark):
    one = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 0)], COLUMNS)
    built = VectorIndex.build(one, new_folder(spark, "index"))
    found = built.search(spark.createDataFrame([(9, [0.1, 0.0], 0)], COLUMNS), 5).collect()
    assert sorted((r.neighbour, r.rank) for r in found) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        built.search(one, 0)
    with pytest.raises(ValueError):
        VectorIndex.build(one.where("id < 0"), new_folder(spark, "index"))


def test_distances_are_held_a_piece_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(500, 4)), rng.normal(size=(50, 4))
    want = vector_index._squared(x, centres).argmin(axis=1)
    held, squared = [], vector_index._squared

    def counted(a, b):
        held.append(len(a) * len(b))
        return squared(a, b)

    monkeypatch.setattr(vector_index, "PIECE_NUMBERS", 1000)
    monkeypatch.setattr(vector_index, "_squared", counted)
    assert np.array_equal(vector_index._nearest(x, centres), want)
    assert max(held) <= 1000 and sum(held) == want.size * 50
