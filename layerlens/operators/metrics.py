"""Scores of predictions against the truth.

Predictions are one long table: key columns, `id`, `y_pred`. The truth has `id` and
`label`, and any of the keys that tell datasets apart. All metrics follow from confusion
counts, so the long table is aggregated once, map-side first, and everything after that
works on one row per key and pair of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from layerlens.functions.ordering import with_id_position

METRICS = ("accuracy", "precision", "recall", "f1_score", "mcc")


def align(preds: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Pairs every prediction with its true label by row key.

    The truth has one row where the predictions have one per layer, pooling and probe. A task
    holds its part of the truth and lets the predictions pass, instead of sorting them.
    """
    return preds.join(truth.withColumnRenamed("label", "y_true").hint("shuffle_hash"), on)


def align_by_position(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs the i-th prediction with the i-th true label, up to the shorter length.

    `preds` has a 1-based `position` within each key; the truth is numbered in id order.
    """
    numbered = with_id_position(truth, "id")
    return preds.join(numbered.withColumnRenamed("label", "y_true"), "position")


def correctness(aligned: DataFrame) -> DataFrame:
    """Adds `correct`, 1 where the prediction equals the truth."""
    return aligned.withColumn("correct", (F.col("y_pred") == F.col("y_true")).cast("int"))


def task_types(truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per dataset the number of classes and whether there are more than two."""
    classes = truth.groupBy(*keys).agg(F.countDistinct("label").alias("n_classes"))
    return classes.withColumn("multi_class", F.col("n_classes") > 2)


def confusion(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, true label and predicted label; cells without rows are left out."""
    return aligned.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the empty cells, over all labels seen in truth or prediction of a key."""
    labels = F.array_sort(
        F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))
    )  # as many entries as classes
    grid = (
        cells.groupBy(*keys)
        .agg(labels.alias("labels"))
        .select(*keys, "labels", F.explode("labels").alias("y_true"))
        .select(*keys, "y_true", F.explode("labels").alias("y_pred"))
    )
    return grid.join(cells, [*keys, "y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def flatten_confusion(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """The matrix of each key as one comma-joined string, row by row."""
    cells = F.array_sort(F.collect_list(F.struct("y_true", "y_pred", "n")))
    counts = F.transform(cells, lambda c: c["n"].cast("string"))
    return matrix.groupBy(*keys).agg(F.array_join(counts, ",").alias("confusion_matrix"))


def class_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Support, predictions, hits, precision, recall and F1 per key and class."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    roles = F.array(
        F.struct(
            F.col("y_true").alias("class"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            hit.alias("hits"),
        ),
        F.struct(
            F.col("y_pred").alias("class"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
            zero.alias("hits"),
        ),
    )
    classes = (
        cells.select(*keys, F.explode(roles).alias("r"))
        .select(*keys, "r.*")
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )

    def rate(hits: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(hits, of), F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return (
        classes.withColumn("precision", rate(hits, predicted))
        .withColumn("recall", rate(hits, support))
        .withColumn("f1_score", rate(2 * hits, support + predicted))
    )


def _mean(metric: str, average: str | Column) -> Column:
    value, support = F.col(metric), F.col("support")
    variants = {
        "binary": lambda: F.coalesce(F.max(F.when(F.col("class") == 1, value)), F.lit(0.0)),
        "macro": lambda: F.avg(value),
        "weighted": lambda: F.sum(support * value) / F.sum(support),
    }
    return variants[average]().alias(metric)


def _accuracy() -> Column:
    return (F.sum("hits") / F.sum("support")).alias("accuracy")


def _matthews() -> Column:
    """Matthews correlation for any number of classes; 0 when one side is constant."""
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")
    rows, hits = F.sum(support), F.sum(F.col("hits").cast("double"))
    cover = hits * rows - F.sum(support * predicted)
    spread = (rows * rows - F.sum(predicted * predicted)) * (rows * rows - F.sum(support * support))
    return F.when(spread > 0, cover / F.sqrt(spread)).otherwise(0.0).alias("mcc")


def scores(classes: DataFrame, keys: list[str], average: str) -> DataFrame:
    """The five metrics per key; `average` is "binary" (class 1), "macro" or "weighted"."""
    if average not in ("binary", "macro", "weighted"):
        raise ValueError(f"Unknown average: {average}")
    means = [_mean(m, average) for m in ("precision", "recall", "f1_score")]
    return classes.groupBy(*keys).agg(_accuracy(), *means, _matthews())


def scores_by_task(classes: DataFrame, keys: list[str], tasks: DataFrame) -> DataFrame:
    """The five metrics per key, macro where the dataset has more than two classes."""
    macro = {m: _mean(m, "macro") for m in ("precision", "recall", "f1_score")}
    binary = {m: _mean(m, "binary") for m in ("precision", "recall", "f1_score")}
    wide = classes.groupBy(*keys).agg(
        _accuracy(),
        *[macro[m].alias(f"{m}_macro") for m in macro],
        *[binary[m].alias(f"{m}_binary") for m in binary],
        _matthews(),
    )
    on = [k for k in keys if k in tasks.columns]
    chosen = [
        F.when(F.col("multi_class"), F.col(f"{m}_macro")).otherwise(F.col(f"{m}_binary")).alias(m)
        for m in macro
    ]
    return wide.join(tasks.select(*on, "multi_class"), on).select(
        *keys, "accuracy", *chosen, "mcc"
    )


def evaluate(
    preds: DataFrame, truth: DataFrame, on: list[str], keys: list[str], average: str = "auto"
) -> DataFrame:
    """One row of metrics per key; "auto" picks binary or macro by the dataset's classes."""
    cells = confusion(align(preds, truth, on), keys)
    classes = class_scores(cells, keys)
    if average != "auto":
        return scores(classes, keys, average)
    datasets = [c for c in on if c != "id"]
    return scores_by_task(classes, keys, task_types(truth, datasets))


def accuracy(aligned: DataFrame, keys: list[str]) -> DataFrame:
    hits = F.when(F.col("y_pred") == F.col("y_true"), 1.0).otherwise(0.0)
    return aligned.groupBy(*keys).agg(F.avg(hits).alias("accuracy"))


def cross_entropy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean loss of a `probability` array against the 0-based `label`."""
    at_label = F.element_at("probability", (F.col("label") + 1).cast("int"))
    return df.groupBy(*keys).agg(F.avg(-F.ln(at_label)).alias("eval_loss"))


def melt(results: DataFrame, ids: list[str], metrics=METRICS) -> DataFrame:
    """One row per metric."""
    return results.unpivot(ids, list(metrics), "metric", "value")
