"""Pooling of token states into one vector per text and layer.

A row holds all token vectors of a text at one layer as `states array<array<double>>`, so
pooling is a projection: it needs no shuffle and runs in the scan's stage.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

PAD = "<pad>"


def truncate_pad(tokens: Column, length: int, pad: str = PAD) -> Column:
    """The first `length` tokens, filled up with `pad`."""
    kept = F.slice(tokens, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)))


def attention_mask(tokens: Column, length: int) -> Column:
    """1 for tokens, 0 for padding, over `length` positions."""
    kept = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))


def _fold(states: Column, combine) -> Column:
    rest = F.slice(states, F.lit(2), F.size(states))
    return F.aggregate(
        rest, F.element_at(states, 1), lambda acc, v: F.zip_with(acc, v, combine)
    )


def _let(value: Column, use) -> Column:
    """Computes `value` once per row and hands it to `use`, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scaled(vector: Column, by: Column) -> Column:
    return F.transform(vector, lambda x: x * by)


def mean_pool(states: Column) -> Column:
    """Mean over all positions, padding included."""
    total = _fold(states, lambda a, b: a + b)
    return _let(F.size(states), lambda n: F.transform(total, lambda x: x / n))


def last_token_pool(states: Column) -> Column:
    return F.element_at(states, -1)


def max_pool(states: Column) -> Column:
    return _fold(states, lambda a, b: F.greatest(a, b))


def min_pool(states: Column) -> Column:
    return _fold(states, lambda a, b: F.least(a, b))


def concat_pool(states: Column) -> Column:
    return F.concat(mean_pool(states), max_pool(states), min_pool(states))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def attention_weights(states: Column) -> Column:
    """Softmax over positions of each position's mean."""
    marks = F.transform(states, lambda v: _sum(v) / F.size(v))

    def peaked(marks: Column) -> Column:
        return _let(F.array_max(marks), lambda top: F.transform(marks, lambda s: F.exp(s - top)))

    def shares(peaks: Column) -> Column:
        return _let(_sum(peaks), lambda total: F.transform(peaks, lambda e: e / total))

    return _let(_let(marks, peaked), shares)


def attention_pool(states: Column) -> Column:
    """Weighted sum of the positions by their attention weights."""
    weighted = F.zip_with(states, attention_weights(states), _scaled)
    return _fold(weighted, lambda a, b: a + b)


def masked_mean_pool(states: Column, mask: Column) -> Column:
    """Mean over the positions whose mask is 1; the count is at least 1e-9."""
    total = _fold(F.zip_with(states, mask, lambda v, m: _scaled(v, m)), lambda a, b: a + b)
    count = F.greatest(_sum(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9))
    return _let(count, lambda n: F.transform(total, lambda x: x / n))


POOLINGS = {
    "mean": mean_pool,
    "last-token": last_token_pool,
    "max": max_pool,
    "min": min_pool,
    "concat-mean-max-min": concat_pool,
    "attention": attention_pool,
}


def pool(states: DataFrame, methods) -> DataFrame:
    """All requested poolings of each row in one pass: (other columns, pooling, features)."""
    unknown = sorted(set(methods) - set(POOLINGS))
    if unknown:
        raise ValueError(f"Unknown pooling method: {', '.join(unknown)}")
    pooled = F.array(
        *[
            F.struct(F.lit(m).alias("pooling"), POOLINGS[m](F.col("states")).alias("features"))
            for m in methods
        ]
    )
    kept = [c for c in states.columns if c != "states"]
    return states.select(*kept, F.explode(pooled).alias("p")).select(*kept, "p.*")


def layer(states: DataFrame, index: int) -> DataFrame:
    return states.filter(F.col("layer") == index)


def first_layers(states: DataFrame, cutoff: int) -> DataFrame:
    """The first `cutoff` layers, all when there are fewer; `is_last` marks the top one."""
    depth = states.agg((F.max("layer") + 1).alias("depth")).scalar()
    kept = states.filter(F.col("layer") < cutoff)
    return kept.withColumn("is_last", F.col("layer") == F.least(depth, F.lit(cutoff)) - 1)


def feature_statistics(features: DataFrame) -> DataFrame:
    """One row with the mean and the population deviation of every dimension."""
    vector = array_to_vector(F.col("features"))
    stats = features.agg(
        Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s")
    )
    n = F.col("s.count").cast("double")
    return stats.select(
        vector_to_array(F.col("s.mean")).alias("mean"),
        F.transform(
            vector_to_array(F.col("s.variance")), lambda v: F.sqrt(v * (n - 1) / n)
        ).alias("deviation"),
    )


def standardise(train: DataFrame, other: DataFrame) -> DataFrame:
    """Centres and scales `other` by the statistics of `train`; constant columns become 0."""
    stats = feature_statistics(train).select(F.struct("mean", "deviation").alias("s")).scalar()
    centred = F.zip_with("features", F.col("_stats.mean"), lambda x, m: x - m)
    scaled = F.zip_with(
        centred, F.col("_stats.deviation"), lambda x, s: F.when(s > 0, x / s).otherwise(x)
    )
    return (
        other.withColumn("_stats", stats).withColumn("features", scaled).drop("_stats")
    )


def class_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct("label").alias("n_classes"))
