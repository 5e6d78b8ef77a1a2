"""Paired tests between probes of the same layer and pooling.

Each row's right and wrong answers form a pattern over the probes. Patterns are counted
first, and pairs of probes are formed on the pattern counts, not on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from layerlens.functions.pvalues import normal_two_sided, student_two_sided
from layerlens.operators.metrics import correctness


def patterns(aligned: DataFrame, keys: list[str], probes=None) -> DataFrame:
    """How many rows show each combination of (probe, correct), per key.

    With the `probes` named, a row's answers are plain columns, which Spark aggregates in
    a hash table; without, they are gathered as a list (one entry per probe).
    """
    rows = correctness(aligned)
    if probes is None:
        answers = F.array_sort(F.collect_list(F.struct("probe", "correct")))
        by_row = rows.groupBy(*keys, "id").agg(answers.alias("answers"))
        return by_row.groupBy(*keys, "answers").agg(F.count("*").alias("n"))
    names = sorted(probes)
    columns = [f"_answer_{i}" for i in range(len(names))]
    by_row = rows.groupBy(*keys, "id").agg(
        *[F.max(F.when(F.col("probe") == p, F.col("correct"))).alias(c) for p, c in zip(names, columns)]
    )
    counts = by_row.groupBy(*keys, *columns).agg(F.count("*").alias("n"))
    listed = F.array(
        *[F.struct(F.lit(p).alias("probe"), F.col(c).alias("correct")) for p, c in zip(names, columns)]
    )
    answered = F.filter(listed, lambda a: a["correct"].isNotNull())
    return counts.select(*keys, answered.alias("answers"), "n")


def pair_answers(aligned: DataFrame, keys: list[str], probes=None) -> DataFrame:
    """Every unordered pair of probes with both answers and the rows that gave them."""
    later = F.filter(F.col("answers"), lambda a: a["probe"] > F.col("one.probe"))
    return (
        patterns(aligned, keys, probes)
        .withColumn("one", F.explode("answers"))
        .withColumn("two", F.explode(later))
        .groupBy(
            *keys,
            F.col("one.probe").alias("probe_1"),
            F.col("two.probe").alias("probe_2"),
            F.col("one.correct").alias("correct_1"),
            F.col("two.correct").alias("correct_2"),
        )
        .agg(F.sum("n").alias("n"))
    )


def discordance(aligned: DataFrame, keys: list[str], probes=None) -> DataFrame:
    """Per probe pair: rows, rows only the first got right, rows only the second did."""

    def only(one: int, two: int):
        hit = (F.col("correct_1") == one) & (F.col("correct_2") == two)
        return F.sum(F.when(hit, F.col("n")).otherwise(0))

    return (
        pair_answers(aligned, keys, probes)
        .groupBy(*keys, "probe_1", "probe_2")
        .agg(F.sum("n").alias("n"), only(1, 0).alias("b"), only(0, 1).alias("c"))
    )


def t_test(pairs: DataFrame) -> DataFrame:
    """Paired t-test on the 0/1 answers, from the discordance counts."""
    n, b, c = (F.col(x).cast("double") for x in "nbc")
    mean = (b - c) / n
    variance = F.greatest(F.try_divide((b + c) - (b - c) * (b - c) / n, n - 1), F.lit(0.0))
    t = F.try_divide(mean, F.sqrt(variance / n))
    same, constant = (b + c) == 0, F.col("variance") == 0
    return (
        pairs.withColumn("variance", variance)
        .withColumn(
            "t_stat",
            F.when(same, 0.0)
            .when(n < 2, F.lit(float("nan")))
            .when(constant, F.when(b > c, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
            .otherwise(t),
        )
        .withColumn(
            "p_value",
            F.when(same, 1.0)
            .when(n < 2, F.lit(float("nan")))
            .when(constant, 0.0)
            .otherwise(student_two_sided(F.col("t_stat"), n - 1)),
        )
        .drop("variance")
    )


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test, large-sample form, zero differences dropped.

    All differences are +1 or -1, so all ranks are tied and the counts are enough.
    """
    b, c = F.col("b").cast("double"), F.col("c").cast("double")
    m = b + c
    z = F.coalesce(F.try_divide(b - c, F.sqrt(m)), F.lit(0.0))
    return (
        pairs.withColumn("stat", F.least(b, c) * (m + 1) / 2)
        .withColumn("z", z)
        .withColumn("p_value", F.when(m == 0, 1.0).otherwise(normal_two_sided(F.col("z"))))
    )


def test_table(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Both tests side by side, one row per key and pair."""
    both = wilcoxon(t_test(pairs).withColumnRenamed("p_value", "t_p_value"))
    return both.select(
        *keys,
        "probe_1",
        "probe_2",
        "t_stat",
        "t_p_value",
        F.col("stat").alias("wilcoxon_stat"),
        F.col("p_value").alias("wilcoxon_p_value"),
    )
