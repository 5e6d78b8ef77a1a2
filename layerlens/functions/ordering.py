"""Ranks and positions over a whole table without sorting it in one task.

Rows get a bucket that follows the sort key. Bucket sizes give each bucket its first
position, and rows are numbered inside their bucket only.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from layerlens.functions.sizing import small_side

BUCKET_ROWS = 100_000  # rows a bucket should hold
MAX_DRAW_DIGITS = 5  # at most 16 ** 5 = 1,048,576 draw buckets
MAX_ID_BUCKETS = 10_000


def draw_digits(rows: int) -> int:
    """Hex digits of a draw to bucket by, so that buckets stay small as the table grows."""
    digits = math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16))
    return min(max(digits, 1), MAX_DRAW_DIGITS)


def draw_bucket(draw: Column, digits: int) -> Column:
    return F.substring(draw, 1, digits)


def id_bucketizer(df: DataFrame, column: str, name: str) -> Bucketizer:
    """Splits a numeric id into ranges that hold about as many rows each.

    The borders are approximate quantiles of the id column, the only column read for them,
    so sparse or clustered ids still spread evenly.
    """
    ids = df.select(F.col(column).cast("double").alias(column))
    buckets = min(max(ids.count() // BUCKET_ROWS, 16), MAX_ID_BUCKETS)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = ids.approxQuantile(column, shares, 0.5 / buckets)
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    return Bucketizer(splits=splits, inputCol=f"{name}_key", outputCol=name)


def with_id_bucket(df: DataFrame, column: str, bucketizer: Bucketizer) -> DataFrame:
    """Adds the bucket of each id; bucket numbers grow with the id."""
    key = bucketizer.getInputCol()
    bucketed = bucketizer.transform(df.withColumn(key, F.col(column).cast("double"))).drop(key)
    name = bucketizer.getOutputCol()
    return bucketed.withColumn(name, F.col(name).cast("int"))


def _with_offsets(
    df: DataFrame, counted: DataFrame, bucket: str, order: list, name: str
) -> DataFrame:
    sizes = counted.groupBy(bucket).agg(F.count("*").alias("_n"))
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    # One row per bucket, at most 16 ** MAX_DRAW_DIGITS of them.
    offsets = sizes.select(bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(bucket).orderBy(*order)
    return (
        df.join(F.broadcast(offsets), bucket)
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop(bucket, "_before")
    )


def with_draw_position(
    df: DataFrame, draw: str, tie: str, name: str = "position", narrow: DataFrame | None = None
) -> DataFrame:
    """1-based position of every row in draw order, over the whole table.

    `narrow` may be a cheaper table with the same rows' draws, to count rows on.
    """
    draws = (df if narrow is None else narrow).select(draw)
    bucket = draw_bucket(F.col(draw), draw_digits(draws.count()))
    counted = draws.select(bucket.alias("_bucket"))
    return _with_offsets(df.withColumn("_bucket", bucket), counted, "_bucket", [draw, tie], name)


def with_id_position(df: DataFrame, row_id: str, name: str = "position") -> DataFrame:
    """1-based position of every row in id order, over the whole table."""
    bucketed = with_id_bucket(df, row_id, id_bucketizer(df, row_id, "_bucket"))
    return _with_offsets(bucketed, bucketed, "_bucket", [row_id], name)


def lowest_draw_cuts(df: DataFrame, group: str, quota: str, draw: str, tie: str) -> DataFrame:
    """Per group the last (draw, id) that is still among its `quota` lowest draws.

    Only the one bucket per group that holds the border is ranked. Groups with fewer rows
    than their quota get no cut: all their rows are in. Quotas must be above zero.
    """
    bucket = draw_bucket(F.col(draw), draw_digits(df.count()))
    bucketed = df.select(group, quota, draw, tie, bucket.alias("_bucket"))
    sizes = bucketed.groupBy(group, "_bucket").agg(
        F.count("*").alias("_n"), F.max(quota).alias("_quota")
    )
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(
            (F.col("_before") < F.col("_quota"))
            & (F.col("_before") + F.col("_n") >= F.col("_quota"))
        )
        .select(group, "_bucket", (F.col("_quota") - F.col("_before")).alias("_rest"))
    )
    rank = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(draw, tie))
    return (
        bucketed.join(small_side(edges), [group, "_bucket"])
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_rest"))
        .select(group, F.col(draw).alias("cut_draw"), F.col(tie).alias("cut_id"))
    )
