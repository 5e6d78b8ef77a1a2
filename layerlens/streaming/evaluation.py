"""Scores prediction files as they arrive; files already seen are not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from layerlens.operators.metrics import align, class_scores, confusion, scores
from layerlens.session import dropped
from layerlens.sources.predictions import RUN_KEY, lines, runs


COUNTED = (*RUN_KEY, "y_true", "y_pred")


def _version(folder: str, batch_id: int) -> str:
    return f"{folder}/upto={batch_id}"


def stored_versions(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose sums are there and complete."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    whole = hadoop.Path(f"{folder}/upto=*/_SUCCESS")
    found = whole.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(whole) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def score_new_files(
    spark: SparkSession,
    folder: str,
    truth: DataFrame,
    counts_folder: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Reads what is new, then stops. The counts of all batches so far are one small table.

    A batch adds its confusion counts to those up to the batch before it and stores the sum
    under its own number; older sums are deleted, but for the one it was made from. A batch
    that is repeated after a failure starts from that one again and overwrites its own, so no
    file is counted twice, and neither folders nor reads grow with the batches.
    """

    def save_counts(batch: DataFrame, batch_id: int) -> None:
        cells = confusion(align(runs(batch), truth, ["id"]), list(RUN_KEY))
        earlier = [v for v in stored_versions(spark, counts_folder) if v < batch_id]
        if earlier:
            cells = cells.unionByName(spark.read.parquet(_version(counts_folder, max(earlier))))
        total = cells.groupBy(*COUNTED).agg(F.sum("n").alias("n"))
        total.write.mode("overwrite").parquet(_version(counts_folder, batch_id))
        dropped(spark, *[_version(counts_folder, v) for v in sorted(earlier)[:-1]])

    return (
        lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder)
        .writeStream.foreachBatch(save_counts)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def confusion_so_far(spark: SparkSession, counts_folder: str) -> DataFrame:
    """The counts up to the last batch that is stored whole."""
    return spark.read.parquet(_version(counts_folder, max(stored_versions(spark, counts_folder))))


def scores_so_far(spark: SparkSession, counts_folder: str, average: str = "binary") -> DataFrame:
    """One row of metrics per run over all files scored so far."""
    cells = confusion_so_far(spark, counts_folder)
    return scores(class_scores(cells, list(RUN_KEY)), list(RUN_KEY), average)
