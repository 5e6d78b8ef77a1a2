"""Stratified reduction of a labelled text table to a size and a mean text length.

The table has `id`, `text` and `label`. One pass over the texts gives a narrow table of
lengths; quotas and the length limit per label follow from a frequency table of it.
Random picks use seeded draws, so they do not depend on partitioning, and the last pick of
a label is found through draw buckets, so no label is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from layerlens.functions.draws import draw
from layerlens.functions.ordering import lowest_draw_cuts, with_draw_position
from layerlens.functions.sizing import small_side
from layerlens.functions.text import text_or_nan, word_count
from layerlens.session import written


def measured(df: DataFrame) -> DataFrame:
    """Rows with a label, with `n_words`; a missing text counts as one word."""
    return df.filter(F.col("label").isNotNull()).withColumn(
        "n_words", word_count(text_or_nan(F.col("text")))
    )


def length_table(df: DataFrame) -> DataFrame:
    """The narrow table (id, label, n_words) that all choices are made on."""
    return written(measured(df).select("id", "label", "n_words"), "lengths")


def _label_table(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("label").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("words"), F.min("id").alias("first_id")
    )


def label_quotas(lengths: DataFrame, total: int) -> DataFrame:
    """Rows to keep per label, in proportion to the label's share.

    Shares are truncated; what is missing to `total` is dealt one each in order of first
    appearance. All windows run over one row per label.
    """
    labels = _label_table(lengths)
    everything = W.partitionBy()
    share = F.col("n") / F.sum("n").over(everything)
    table = labels.withColumn("base", F.floor(F.lit(total) * share)).withColumn(
        "turn", F.row_number().over(W.orderBy("first_id"))
    )
    table = table.withColumn("open", F.lit(total) - F.sum("base").over(everything)).withColumn(
        "labels", F.count("*").over(everything)
    )
    rounds = F.floor(F.abs("open") / F.col("labels"))
    extra = (F.col("turn") <= F.abs("open") % F.col("labels")).cast("int")
    return table.select(
        "label",
        "n",
        "words",
        "first_id",
        (F.col("base") + F.signum("open").cast("int") * (rounds + extra)).alias("quota"),
    )


def _prefix_plan(lengths: DataFrame, quotas: DataFrame, max_mean: float) -> DataFrame:
    """Per label the last length of the shortest-first prefix and the rows to take of it.

    Among rows of one length the running mean moves one way, so the number of rows that
    still fit follows from the counts and sums of the shorter lengths.
    """
    freq = lengths.groupBy("label", "n_words").agg(F.count("*").alias("n"))
    shorter = W.partitionBy("label").orderBy("n_words").rowsBetween(W.unboundedPreceding, -1)
    size = F.col("n_words").cast("double")
    before = freq.withColumn("rows", F.coalesce(F.sum("n").over(shorter), F.lit(0))).withColumn(
        "sum", F.coalesce(F.sum(F.col("n") * size).over(shorter), F.lit(0.0))
    )
    spare = F.lit(float(max_mean)) * F.col("rows") - F.col("sum")
    limit = F.lit(float(max_mean))
    about = F.floor(F.try_divide(spare, size - limit))

    def fits(m):
        return F.try_divide(F.col("sum") + m * size, F.col("rows") + m) <= limit

    # The quotient can be off by one where the mean meets the limit exactly.
    exact = F.when((about >= 0) & fits(about + 1), about + 1).when((about > 0) & ~fits(about), about - 1).otherwise(about)
    by_mean = F.when(size <= max_mean, F.col("n")).otherwise(exact)
    kept = F.least(F.col("n"), by_mean, F.col("quota") - F.col("rows"))
    return (
        before.join(quotas.select("label", "quota"), "label")
        .withColumn("kept", kept)
        .filter(F.col("kept") > 0)
        .groupBy("label")
        .agg(F.max("n_words").alias("limit_len"), F.max_by("kept", "n_words").alias("rest"))
    )


def selection_plan(
    lengths: DataFrame, quotas: DataFrame, max_mean: float, mode: str = "auto"
) -> DataFrame:
    """How each label is cut: (label, limit_len, rest).

    With a `limit_len`, shorter rows are all kept and `rest` rows of that length by draw;
    without one, `rest` rows of the whole label by draw. `mode` is "prefix" (shortest first
    for every label), "random", or "auto" (shortest first where the mean is above
    `max_mean`).
    """
    too_long = {
        "prefix": F.lit(True),
        "random": F.lit(False),
        "auto": F.col("words") / F.col("n") > max_mean,
    }[mode]
    prefix = _prefix_plan(lengths, quotas, max_mean)
    plan = quotas.withColumn("shortest_first", too_long).join(prefix, "label", "left")
    return plan.select(
        "label",
        F.when(F.col("shortest_first"), F.coalesce("limit_len", F.lit(-1))).alias("limit_len"),
        F.when(F.col("shortest_first"), F.coalesce("rest", F.lit(0)))
        .otherwise(F.greatest("quota", F.lit(0)))
        .alias("rest"),
    )


def selection(lengths: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan with each label's last chosen draw: what `selected` needs, a row per label."""
    plan = small_side(plan)
    at_limit = F.col("limit_len").isNull() | (F.col("n_words") == F.col("limit_len"))
    candidates = (
        lengths.join(plan, "label")
        .filter(at_limit & (F.col("rest") > 0))
        .select("label", "rest", "id", draw(F.col("id"), seed).alias("draw"))
    )
    cuts = lowest_draw_cuts(candidates, "label", "rest", "draw", "id")
    return small_side(plan.join(cuts, "label", "left"))


def selected(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """The measured rows that the selection keeps, with their `draw`."""
    at_limit = F.col("limit_len").isNull() | (F.col("n_words") == F.col("limit_len"))
    chosen = (F.col("rest") > 0) & (
        F.col("cut_draw").isNull()
        | (F.col("draw") < F.col("cut_draw"))
        | ((F.col("draw") == F.col("cut_draw")) & (F.col("id") <= F.col("cut_id")))
    )
    shorter = F.coalesce(F.col("n_words") < F.col("limit_len"), F.lit(False))
    return (
        rows.withColumn("draw", draw(F.col("id"), seed))
        .join(cuts, "label")
        .filter(shorter | (at_limit & chosen))
        .drop("limit_len", "rest", "cut_draw", "cut_id")
    )


def _chosen(
    lengths: DataFrame, total: int, max_mean: float, mode: str, seed: int
) -> DataFrame:
    quotas = small_side(label_quotas(lengths, total))
    return selection(lengths, selection_plan(lengths, quotas, max_mean, mode), seed)


def shortest_prefix(df: DataFrame, total: int, max_mean: float, seed: int = 42) -> DataFrame:
    """Per label the shortest rows while their mean stays within `max_mean` and the quota."""
    cuts = _chosen(length_table(df), total, max_mean, "prefix", seed)
    return selected(measured(df), cuts, seed)


def random_quota(df: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """Per label a seeded random sample of its quota, without replacement."""
    cuts = _chosen(length_table(df), total, 0.0, "random", seed)
    return selected(measured(df), cuts, seed)


def shuffled(df: DataFrame, seed: int = 42, narrow: DataFrame | None = None) -> DataFrame:
    """A seeded order over the whole table as column `position`."""
    if "draw" not in df.columns:
        df = df.withColumn("draw", draw(F.col("id"), seed))
    return with_draw_position(df, "draw", "id", narrow=narrow)


def _checked(lengths: DataFrame, total: int, max_mean: float, seed: int) -> DataFrame:
    if total > lengths.count():
        raise ValueError("The requested total is larger than the table.")
    return _chosen(lengths, total, max_mean, "auto", seed)


def sample_union(df: DataFrame, total: int, max_mean: float, seed: int = 42) -> DataFrame:
    """All labels' samples in one table."""
    cuts = _checked(length_table(df), total, max_mean, seed)
    return selected(measured(df), cuts, seed)


def bounded_reduction(df: DataFrame, total: int, max_mean: float, seed: int = 42) -> DataFrame:
    """A label-proportional sample of `total` rows whose mean length is within `max_mean`.

    A label with too few short rows gives fewer than its quota; `reduction_summary` shows
    the shortfall. The texts are read twice: for their lengths, and to write the sample.
    """
    lengths = length_table(df)
    cuts = _checked(lengths, total, max_mean, seed)
    narrow = selected(lengths, cuts, seed)
    mean = narrow.agg(F.avg("n_words")).first()[0]
    if mean is not None and mean > max_mean:
        raise ValueError("The mean text length cannot be met without distorting the labels.")
    return shuffled(selected(measured(df), cuts, seed), seed, narrow)


def _stage(df: DataFrame, name: str) -> DataFrame:
    everything = W.partitionBy()
    labels = df.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n_words").alias("words"))
    share: Column = F.col("rows") / F.sum("rows").over(everything)
    mean = F.sum("words").over(everything) / F.sum("rows").over(everything)
    return labels.select(
        F.lit(name).alias("stage"),
        "label",
        "rows",
        share.alias("share"),
        mean.alias("mean_words"),
    )


def reduction_summary(df: DataFrame, total: int, max_mean: float, seed: int = 42) -> DataFrame:
    """Size, label shares and mean length before and after, and rows missing to the quota."""
    lengths = length_table(df)
    quotas = small_side(label_quotas(lengths, total))
    cuts = selection(lengths, selection_plan(lengths, quotas, max_mean), seed)
    kept = selected(lengths, cuts, seed)
    before = _stage(lengths, "before").withColumn("shortfall", F.lit(0).cast("long"))
    after = (
        _stage(kept, "after")
        .join(quotas.select("label", "quota"), "label")
        .withColumn("shortfall", F.col("quota") - F.col("rows"))
        .drop("quota")
    )
    return before.unionByName(after)
