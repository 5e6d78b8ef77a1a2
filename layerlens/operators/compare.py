"""Comparison of result rows: best layers, poolings, probes and trials.

The best row of a group is a partial aggregate (the smallest of -metric and the tie-break
columns), not a sort of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from layerlens.functions.draws import hex_number
from layerlens.operators.metrics import METRICS

REPLICATES = 1000


def best(results: DataFrame, by: list[str], metric: str, ties: list[str]) -> DataFrame:
    """Per group the row with the highest metric; ties go to the lowest `ties` columns."""
    order = F.struct((-F.col(metric)).alias("order"), *ties)
    return (
        results.groupBy(*by)
        .agg(F.min(order).alias("b"))
        .select(*by, (-F.col("b.order")).alias(metric), *[F.col(f"b.{t}") for t in ties])
    )


def best_value(results: DataFrame, by: list[str], metric: str) -> DataFrame:
    return results.groupBy(*by).agg(F.max(metric).alias(f"best_{metric}"))


def mean_metrics(results: DataFrame, by: list[str], metrics=METRICS) -> DataFrame:
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def accuracy_curve(results: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy by layer and its change from the layer before, per curve."""
    along = W.partitionBy(*by).orderBy("layer")
    return results.select(
        *by,
        "layer",
        "accuracy",
        (F.col("accuracy") - F.lag("accuracy").over(along)).alias("change"),
    )


def interaction(results: DataFrame, by: list[str], member: str, seed: int = 42) -> DataFrame:
    """Mean accuracy per group with a 95 % bootstrap interval.

    Each replicate redraws as many result rows as the group has; row k of replicate r is
    picked by a seeded digest, so the interval is the same on every run.
    """
    order = F.array_sort(F.collect_list(F.struct(member, "accuracy")))
    groups = results.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy"), F.transform(order, lambda s: s["accuracy"]).alias("v")
    )
    name = F.concat_ws("|", *by, F.col("replicate"), F.col("slot"), F.lit(seed))
    pick = hex_number(F.md5(name), 7) % F.size("v")
    means = (
        groups.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES))))
        .withColumn("slot", F.explode(F.sequence(F.lit(1), F.size("v"))))
        .groupBy(*by, "accuracy", "replicate")
        .agg(F.avg(F.element_at("v", (pick + 1).cast("int"))).alias("mean"))
    )
    low, high = F.percentile("mean", F.lit(0.025)), F.percentile("mean", F.lit(0.975))
    return means.groupBy(*by, "accuracy").agg(low.alias("ci_low"), high.alias("ci_high"))
