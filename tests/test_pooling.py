import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.operators import pooling

STATES = "id long, layer int, states array<array<double>>"


def _states(n=12, dims=5):
    rng = random.Random(1)
    return [
        (i, layer, [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(1 + i % 4)])
        for i in range(n)
        for layer in (0, 1, 2)
    ]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(_states(), STATES)


def _expected(method, x):
    score = np.exp(x.mean(axis=1) - x.mean(axis=1).max())
    weights = score / score.sum()
    return {
        "mean": x.mean(axis=0),
        "last-token": x[-1],
        "max": x.max(axis=0),
        "min": x.min(axis=0),
        "concat-mean-max-min": np.concatenate([x.mean(axis=0), x.max(axis=0), x.min(axis=0)]),
        "attention": (x * weights[:, None]).sum(axis=0),
    }[method]


def test_all_poolings(states):
    rows = pooling.pool(states, list(pooling.POOLINGS)).collect()
    source = {(i, layer): np.array(s) for i, layer, s in _states()}
    assert len(rows) == len(source) * 6
    for r in rows:
        assert r.features == pytest.approx(_expected(r.pooling, source[r.id, r.layer]).tolist())


def test_attention_weights_sum_to_one_and_survive_large_values(spark):
    df = spark.createDataFrame([(1, 0, [[1e5, 2e5], [1e5, 2e5 + 1], [-1e5, 0.0]])], STATES)
    weights = df.select(pooling.attention_weights(F.col("states"))).first()[0]
    assert sum(weights) == pytest.approx(1.0) and all(math.isfinite(w) for w in weights)


def test_unknown_pooling(states):
    with pytest.raises(ValueError):
        pooling.pool(states, ["median"])


def test_masked_mean(spark):
    df = spark.createDataFrame(
        [(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0])],
        "id long, states array<array<double>>, mask array<int>",
    )
    pooled = df.select("id", pooling.masked_mean_pool(F.col("states"), F.col("mask")).alias("f"))
    got = {r.id: r.f for r in pooled.collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_truncate_pad(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>")
    got = df.select(pooling.truncate_pad(F.col("t"), 2), pooling.attention_mask(F.col("t"), 4)).collect()
    assert [list(r) for r in got] == [
        [["a", "b"], [1, 1, 1, 0]],
        [["<pad>", "<pad>"], [0, 0, 0, 0]],
    ]


@pytest.mark.parametrize("cutoff,last", [(2, 1), (3, 2), (9, 2)])
def test_depth_cutoff(states, cutoff, last):
    rows = pooling.first_layers(states, cutoff).select("layer", "is_last").distinct().collect()
    assert {r.layer for r in rows if r.is_last} == {last}
    assert {r.layer for r in rows} == set(range(last + 1))


def test_standardise_uses_train_and_keeps_constants(spark):
    train = spark.createDataFrame([(1, [1.0, 7.0]), (2, [3.0, 7.0])], "id long, features array<double>")
    other = spark.createDataFrame([(3, [5.0, 8.0])], "id long, features array<double>")
    assert pooling.standardise(train, other).first().features == [3.0, 1.0]
    scaled = [r.features for r in pooling.standardise(train, train).orderBy("id").collect()]
    assert scaled == [[-1.0, 0.0], [1.0, 0.0]]
